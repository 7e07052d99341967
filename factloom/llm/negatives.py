"""Hard negatives by distributed radix selection over integer scores.

A window is what one anchor looks for: rows of its own label (for its positives) or of other labels (for the
negatives of one of its positives) whose score, an integer inner product, lies in a range; the first `k` of them by
falling score, ties by smaller vec_id. All windows are selected together:

1. Vectors are dealt into blocks and anchors into groups, both of bounded size, and each block meets each group in one task,
   where the scores are one matrix product. Nothing is scored outside such a task and no pair becomes a row.
2. A task gives, for each window, a histogram of the leading digit (8 bits) of `top of the range - score`, from the top
   down to the bucket where it has counted as many as the window needs: a lower bucket cannot hold the k-th of all.
   The histograms are added up by Spark, and the bucket that holds the k-th score is located.
3. Where that bucket holds more than a few rows, the next digit is counted inside it, until its scores are one score or
   the rows are few. The number of rounds is that of the digits of the widest range, whatever the number of rows.
4. Now each window's least score is known. Only rows that reach it are gathered, of each block the first k at most, so that a score that
   thousands of rows share stays bounded and exact; a last rank over these few rows gives the result.

The windows of negatives need the scores of the positives, so the selection runs twice. Work is one matrix product for each round
(anchors times rows, as every exact search of unpruned data); what is shuffled is one copy of a block for each group of anchors.

Defined results: rows with a null id, label or vector, an empty vector, or null or non-finite components take no part. Vectors
meet only those of their own length. A repeated vec_id is as many candidates, none of them for an anchor of that id; as an anchor it counts
once, with its smallest vector and label. Fewer than k rows are all returned; a window without rows gives none. Scores are exact
and held to 2**61 either way. No rows give no rows; other columns are left out.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import durable

#: Bits of a digit; rows of a window from which on its bucket is not refined any more, as a multiple of k.
DIGIT, FEW = 8, 4
#: Rows of a block, at most and at least, about; anchors of a group, about; numbers of a score matrix.
BLOCK, LEAST_BLOCK, GROUP, MATRIX = 32_768, 2_048, 16_384, 1 << 22
LIMIT = 1 << 61


def whole_vectors(embeddings: DataFrame, *, scale: int = 256) -> DataFrame:
    """vec_id, label and v, floor(scale * x) of every component, of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where((F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products, by Python's integers where doubles are too short."""
    if np.abs(a).max() * np.abs(x).max() * a.shape[1] < 2**53:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object)
    return np.clip(whole(a) @ whole(x).T, -LIMIT, LIMIT).astype(np.int64)


def _scored(asks: pd.DataFrame, rows: pd.DataFrame):
    """For each anchor of asks: its row, and the scores and places of the rows that its windows may hold."""
    x, ids, labels = _matrix(rows["v"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    some = max(1, MATRIX // len(x))
    for at in range(0, len(asks), some):
        part = asks.iloc[at : at + some]
        for ask, s in zip(part.itertuples(index=False), scores(_matrix(part["v"]), x)):
            of_label = labels == ask.label
            inside = (of_label if ask.same else ~of_label) & (ids != ask.anchor_id) & (s >= min(ask.lows)) & (s <= max(ask.tops))
            where = np.nonzero(inside)[0]
            if len(where):
                yield ask, s[where], where


def count(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """anchor_id, slot, bucket, n: the histogram of each window, down to the bucket that has as many as it needs."""
    out: list[tuple] = []
    if len(asks) and len(rows):
        for ask, s, _ in _scored(asks, rows):
            for slot, low, top, need, shift in zip(ask.slots, ask.lows, ask.tops, ask.needs, ask.shifts):
                n = np.bincount((top - s[(s >= low) & (s <= top)]) >> shift)
                n = n[: int(np.searchsorted(np.cumsum(n), need)) + 1]
                out += [(ask.anchor_id, slot, int(b), int(n[b])) for b in np.nonzero(n)[0]]
    return pd.DataFrame(out, columns=["anchor_id", "slot", "bucket", "n"])


def gather(asks: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """anchor_id, slot, vec_id, score: the first k rows of each window in this block."""
    out: list[tuple] = []
    if len(asks) and len(rows):
        ids = rows["vec_id"].to_numpy()
        for ask, s, where in _scored(asks, rows):
            for slot, low, top in zip(ask.slots, ask.lows, ask.tops):
                inside = np.nonzero((s >= low) & (s <= top))[0]
                first = inside[np.lexsort((ids[where[inside]], -s[inside]))[:k]]
                out += [(ask.anchor_id, slot, int(ids[where[i]]), int(s[i])) for i in first]
    return pd.DataFrame(out, columns=["anchor_id", "slot", "vec_id", "score"])


class Selection:
    """Vectors in blocks and anchors in groups, kept once; `select` runs windows over them."""

    def __init__(self, vectors: DataFrame, is_anchor: Column, *, block: int | None = None, group: int = GROUP):
        spark = vectors.sparkSession
        # The salt tells equal rows apart, so that a row repeated many times is dealt over all blocks; it is fixed once written.
        kept = durable(vectors.select("vec_id", "label", "v", F.size("v").alias("d"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")))
        size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        n, widest = kept.agg(F.count(F.lit(1)), F.max(size(F.col("v")))).first()
        if block is None:
            block = min(BLOCK, max(LEAST_BLOCK, n // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
        self.blocks = max(1, -(-n // block))
        once = kept.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a"))
        named = once.select(F.col("vec_id").alias("anchor_id"), "a.v", "a.label", F.size("a.v").alias("d"), (size(F.col("a.v")) * (widest or 0.0) * 1.000001 + 1).alias("reach"))
        self.groups = max(1, -(-named.count() // group))
        self.anchors = durable(named.withColumn("grp", F.pmod(F.xxhash64("anchor_id"), F.lit(self.groups)).cast("int")))
        self.rows = kept.withColumn("blk", F.pmod("salt", F.lit(self.blocks)).cast("int")).drop("salt")

    def _meet(self, windows: DataFrame, same: bool, run, schema: str) -> DataFrame:
        """What run gives for each group of asking anchors and each block."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        # An anchor has few windows: the number of its positives at most.
        listed = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "low", "top", "need", "shift")).alias("w"))
        columns = {"slot": "slots", "low": "lows", "top": "tops", "need": "needs", "shift": "shifts"}
        asks = self.anchors.join(listed, "anchor_id").select("anchor_id", "label", "v", "d", "grp", every(self.blocks).alias("blk"), F.lit(same).alias("same"), *[F.col("w")[c].alias(t) for c, t in columns.items()])
        keys = ["d", "grp", "blk"]
        return asks.groupBy(*keys).cogroup(self.rows.withColumn("grp", every(self.groups)).groupBy(*keys)).applyInPandas(run, schema)

    def select(self, ranges: DataFrame, *, same: bool, k: int) -> DataFrame:
        """anchor_id, slot, vec_id, score, rank of the first k of each window of ranges (anchor_id, slot, low, top)."""
        bits = F.ceil(F.log2((F.col("top") - F.col("low")).cast("double") + 1)).cast("int")
        start = ranges.where("low <= top").withColumns({"shift": F.greatest(F.lit(0), bits - DIGIT), "need": F.lit(k), "least": F.col("low"), "first": F.col("top"), "open": F.lit(True)})
        windows = durable(start)
        while windows.where("open").limit(1).count():
            open_ = windows.where("open")
            n = self._meet(open_, same, count, "anchor_id long, slot int, bucket long, n long").groupBy("anchor_id", "slot", "bucket").agg(F.sum("n").alias("n"))
            # At most 2**DIGIT buckets of a window are ordered here.
            down = W.partitionBy("anchor_id", "slot").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
            upto = n.withColumn("upto", F.sum("n").over(down)).join(open_.select("anchor_id", "slot", "need"), ["anchor_id", "slot"]).where("upto >= need")
            found = upto.groupBy("anchor_id", "slot").agg(F.min(F.struct("bucket", "n", "upto")).alias("at"))
            at, step = F.col("at"), F.expr("shiftleft(1L, shift)")
            there = F.col("open") & at.isNotNull()
            bottom = F.greatest(F.col("low"), F.col("top") - (at["bucket"] + 1) * step + 1)
            few = (F.col("shift") == 0) | (F.lit(k) - F.col("need") + at["upto"] <= FEW * k)
            windows = durable(
                windows.join(found, ["anchor_id", "slot"], "left").select(
                    "anchor_id", "slot", "first",
                    F.when(there, F.col("top") - at["bucket"] * step).otherwise(F.col("top")).alias("top"),
                    F.when(there, bottom).otherwise(F.col("low")).alias("low"),
                    F.when(there, bottom).otherwise(F.col("least")).alias("least"),
                    F.when(there, F.col("need") - (at["upto"] - at["n"])).otherwise(F.col("need")).cast("int").alias("need"),
                    F.greatest(F.lit(0), F.col("shift") - DIGIT).alias("shift"),
                    (there & ~few).alias("open"),  # what has fewer rows than it needs is wanted whole
                )
            )
        wanted = windows.select("anchor_id", "slot", F.col("least").alias("low"), F.col("first").alias("top"), "need", "shift")
        best = self._meet(wanted, same, lambda a, r: gather(a, r, k), "anchor_id long, slot int, vec_id long, score long")
        rank = F.row_number().over(W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, percent: int = 80, block: int | None = None, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors are (vec_id, label, v). Negatives score at most as their positive does, and at least `percent` of it.
    """
    chosen = Selection(vectors, is_anchor, block=block, group=group)
    reach = F.least(F.ceil("reach").cast("double"), F.lit(float(LIMIT))).cast("long")
    of_own = chosen.anchors.select("anchor_id", F.lit(0).alias("slot"), (-reach).alias("low"), reach.alias("top"))
    near = durable(
        chosen.select(of_own, same=True, k=positives).select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    # 80 % of a score under zero is more than the score: such a window is empty.
    low = F.ceil(F.col("positive_score").cast("decimal(20,0)") * percent / 100).cast("long")
    ranges = near.where("positive_score >= 0").select("anchor_id", "slot", low.alias("low"), F.col("positive_score").alias("top"))
    found = chosen.select(ranges, same=False, k=negatives).join(near, ["anchor_id", "slot"])
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
