"""Candidates: for each fact its nearest others of the same project and kind, by cosine distance.

A group of up to a block of facts is solved in one task. A larger one is cut into the Voronoi cells of pivots,
and a cell into parts of about a block; two cells meet only if, by their pivots' distance and their radii,
facts of them can be within the distance limit. Where most cells would meet, cells only copy facts: such a group is
cut into parts by hash. Pairs of parts meet in tasks of bounded size, where products of floats leave out all but those that
can be among the nearest k, whose distances are summed in double, component by component, so that copies tie. No other pair is a row.

Embeddings that are null or empty, or hold null or non-finite components, take no part; facts meet only those whose
embedding is as long as theirs. The same key in two groups names two facts.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from factloom.sources.shared import durable

#: Facts of a part, about, with embeddings of up to WIDE components, and fewer of longer ones; pivots at most; up to how many rows
#: a table of groups or cells is broadcast; and which share of the pairs of a group meets where cells are of no use.
BLOCK, WIDE, PIVOTS, MOST_BROADCAST, DENSE = 32_768, 256, 128, 100_000, 0.5
#: Pairs of parts are dealt to so many tasks each, up to so many in all; no task waits for another that has several pairs.
TASKS, MOST_TASKS = 4, 4096
#: Products that a task holds at once.
PRODUCTS = 1 << 21
NEAREST, MOST_DISTANT = 10, 0.45
FAR_NEAREST, FAR_MOST_DISTANT = 3, 0.30


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(x, np.float64) for x in column])
    size = np.sqrt((m**2).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _checked(df: DataFrame) -> DataFrame:
    """The frame, written once; marked for broadcast if its rows are few."""
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def _dealt(rows: DataFrame, group: tuple[str, ...], reach: float | None) -> tuple[DataFrame, DataFrame, int]:
    """rows that ask and rows that are found, each copied to the pairs of parts where it meets others; and how many such pairs there are.

    reach is the largest distance of unit vectors that counts, None for any.
    """
    if "_length" not in rows.columns:
        rows, group = rows.withColumn("_length", F.size("embedding")), (*group, "_length")
    by, one = list(group), {"cell": F.lit(-1), "part": F.lit(0), "other_cell": F.lit(-1), "other_part": F.lit(0)}
    parts = lambda n: F.ceil(n * F.greatest(F.col("_length"), F.lit(WIDE)) / (WIDE * BLOCK)).cast("int")
    large = _checked(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(parts(F.col("n")) > 1).withColumn("large", F.lit(True)))
    if not large.count():
        return rows.where("asks").withColumns(one), rows.where("found").withColumns(one), 0
    marked = rows.join(large.drop("n"), by, "left")
    small = marked.where("large IS NULL").drop("large").withColumns(one)
    kept = marked.where("large").drop("large")
    whole = large.select(*by, F.lit(-1).alias("cell"), parts(F.col("n")).alias("parts"), F.lit(-1).alias("other_cell"), parts(F.col("n")).alias("other_parts"))
    if reach is None:
        return _parted(small, kept.withColumn("cell", F.lit(-1)), _checked(whole), by)
    # Pivots of each length of embeddings (there are few lengths), padded to the longest; a fact goes to one of its own length.
    lengths = [r[0] for r in large.select("_length").distinct().collect()]
    chosen = [r["embedding"] for n in sorted(lengths) for r in marked.where(F.col("large") & (F.col("_length") == n)).orderBy(F.xxhash64("id"), "id").select("embedding").limit(PIVOTS).collect()]
    size = np.array([len(e) for e in chosen])
    pivots = np.zeros((len(chosen), size.max()))
    for n in lengths:
        pivots[size == n, :n] = _unit(pd.Series([e for e in chosen if len(e) == n]))

    texts = {name for name, kind in rows.dtypes if kind == "string"}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, g in f.groupby("_length"):
                x, own = _unit(g["embedding"]), np.nonzero(size == n)[0]
                at = pivots[own, :n]
                near = (x @ at.T - (at**2).sum(axis=1) / 2).argmax(axis=1)
                yield g.astype({c: object for c in g.columns if c in texts}).assign(cell=own[near].astype("int32"), apart=np.sqrt(((x - at[near]) ** 2).sum(axis=1)))

    placed = durable(kept.mapInPandas(place, StructType([*kept.schema.fields, StructField("cell", IntegerType()), StructField("apart", DoubleType())])))
    cells = _checked(placed.groupBy(*by, "cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")))
    apart = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    between = F.get(F.from_json(F.lit(str(apart.ravel().tolist())), "array<double>"), F.col("cell") * len(pivots) + F.col("other_cell"))
    near = between - F.col("radius") - F.col("other_radius") <= reach + 1e-9
    every = cells.join(cells.select(*by, F.col("cell").alias("other_cell"), F.col("radius").alias("other_radius"), F.col("n").alias("other_n")), by).withColumn("near", near)
    product = F.col("n").cast("double") * F.col("other_n")
    dense = _checked(every.groupBy(*by).agg((F.sum(F.when(F.col("near"), product)) / F.sum(product)).alias("share")).where(F.col("share") > DENSE).select(*by, F.lit(True).alias("dense")))
    apart_ = every.where("near").join(dense, by, "left_anti").select(*by, "cell", parts(F.col("n")).alias("parts"), "other_cell", parts(F.col("other_n")).alias("other_parts"))
    met = _checked(apart_.unionByName(whole.join(dense, by, "left_semi")))
    celled = placed.join(dense, by, "left").withColumn("cell", F.when(F.col("dense"), F.lit(-1)).otherwise(F.col("cell"))).drop("dense")
    return _parted(small, celled, met, by)


def _parted(small: DataFrame, placed: DataFrame, met: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """small, and placed copied to the parts of the cells that its cell meets; those that ask, those that are found, and the pairs of parts."""
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = placed.where("asks").join(met, [*by, "cell"]).withColumn("part", own("parts")).withColumn("other_part", every("other_parts"))
    right = placed.where("found").withColumnRenamed("cell", "other_cell").join(met, [*by, "other_cell"]).withColumn("other_part", own("other_parts")).withColumn("part", every("parts"))
    both = lambda side, named: small.where(named).unionByName(side.select(*small.columns))
    pairs = met.agg(F.sum(F.col("parts").cast("long") * F.col("other_parts"))).first()[0]
    return both(left, "asks"), both(right, "found"), pairs or 0


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a column, all of one length, their squared lengths, and the vectors as floats of length 1."""
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = values.reshape(len(column), -1)
    size = np.cumsum(m * m, axis=1)[:, -1]
    root = np.sqrt(size)[:, None]
    return m, size, np.divide(m, root, out=np.zeros_like(m), where=root > 0).astype(np.float32)


def _first_copies(ids: pa.ChunkedArray, column: pa.ChunkedArray, most: int) -> np.ndarray:
    """Rows by rising id; of rows with the same vector the first `most`, as others are farther back for whoever asks."""
    order = pc.sort_indices(ids).to_numpy()
    m = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)[order]
    same = pd.Series(np.ascontiguousarray(m).view(f"V{m.itemsize * m.shape[1]}").ravel().tolist())
    return order[(same.groupby(same).cumcount() < most).to_numpy()]


def _nearest_of(a: pa.Table, b: pa.Table, k: int, most: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and their distances: of each row of a the k nearest, without rows of its own id."""
    # One more copy than k for each row of the same id, which may stand among them.
    again = b["id"].to_pandas().value_counts(dropna=False).max()
    chosen = _first_copies(b["id"], b["embedding"], k + int(again))
    b = b.take(chosen)
    (x, x_size, x_unit), (y, y_size, y_unit) = _vectors(a["embedding"]), _vectors(b["embedding"])
    codes, _ = pd.factorize(pd.concat([a["id"].to_pandas(), b["id"].to_pandas()], ignore_index=True))
    ours = pd.DataFrame({"code": codes[: len(a)], "i": np.arange(len(a))}).merge(pd.DataFrame({"code": codes[len(a) :], "j": np.arange(len(b))}), on="code").sort_values("i")
    own_i, own_j = ours["i"].to_numpy(), ours["j"].to_numpy()
    # The k-th of the largest of each comb of products is no more than the k-th of all; only combs with a product as large are read again.
    wide = max(1, len(b) // (128 * k))
    combs, slack = len(b) // wide, 4 * (x.shape[1] + 8) * 2.0**-24
    teeth, left = np.arange(wide) * combs, combs * wide
    step, out = min(max(1, PRODUCTS // len(b)), len(a)), []
    held = np.empty((step, len(b)), np.float32)
    for i in range(0, len(a), step):
        s = np.matmul(x_unit[i : i + step], y_unit.T, out=held[: len(a) - i])
        lo, hi = np.searchsorted(own_i, [i, i + step])
        s[own_i[lo:hi] - i, own_j[lo:hi]] = -np.inf
        tops = s[:, :left].reshape(len(s), wide, combs).max(axis=1)
        if combs > k:
            least = np.partition(tops, combs - k, axis=1)[:, combs - k] - np.float32(slack)
        else:
            least = np.full(len(s), -2, np.float32)
        if most is not None:
            least = np.maximum(least, np.float32(1 - most - slack))
        least = np.maximum(least, np.float32(-2))
        row, comb = np.nonzero(tops >= least[:, None])
        near, tooth = np.nonzero(s[row[:, None], comb[:, None] + teeth] >= least[row][:, None])
        last, rest = np.nonzero(s[:, left:] >= least[:, None])
        q, j = np.concatenate([row[near], last]), np.concatenate([comb[near] + teeth[tooth], rest + left])
        for at in range(0, len(q), step_ := max(1, PRODUCTS // x.shape[1])):
            qs, js = q[at : at + step_] + i, j[at : at + step_]
            size = np.sqrt(x_size[qs] * y_size[js])
            dot = np.cumsum(x[qs] * y[js], axis=1)[:, -1]
            out.append((qs, js, 1 - np.clip(np.divide(dot, size, out=np.zeros_like(dot), where=size > 0), -1, 1)))
    q, j, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    if most is not None:
        q, j, d = q[d <= most], j[d <= most], d[d <= most]
    order = np.lexsort((j, d, q))
    q, j, d = q[order], j[order], d[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], chosen[j[first]], d[first]


def nearest(facts: DataFrame, *, k: int = NEAREST, most: float | None = MOST_DISTANT, group: tuple[str, ...] = ("project_id", "fact_kind"), key: str = "fact_id", of: Column | None = None, among: Column | None = None) -> DataFrame:
    """group, fact, other, distance, rank: the k nearest, and of those the ones not over `most`.

    `of` and `among` choose the facts that ask and those that are found. Ties go to the smaller key.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named, group = group, (*group, "_length")
    rows = facts.where((F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True))).select(
        *named, F.size("embedding").alias("_length"), F.col(key).alias("id"), "embedding", (F.lit(True) if of is None else of).alias("asks"), (F.lit(True) if among is None else among).alias("found")
    )
    left, right, pairs = _dealt(rows, group, None if most is None else float(np.sqrt(2 * most)))
    kind, keys = dict(rows.dtypes), [*group, "cell", "part", "other_cell", "other_part"]
    left, right = (side.select(*[F.col(c).alias(c) for c in (*keys, "id", "embedding")]) for side in (left, right))
    if pairs:
        # Parts are few bytes and much work: by bytes they would be merged into a few tasks.
        n = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS * pairs, MOST_TASKS))
        left, right = (side.repartition(n, *keys) for side in (left, right))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        q, j, d = _nearest_of(a, b, k, most) if len(a) and len(b) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        columns = {c: a[c].take(np.zeros(len(q), int)) for c in group} | {"fact": a["id"].take(q), "other": b["id"].take(j), "distance": pa.array(d, pa.float64())}
        return pa.table(columns)

    schema = ", ".join([*(f"{c} {kind[c]}" for c in group), f"fact {kind['id']}, other {kind['id']}, distance double"])
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    rank = F.row_number().over(W.partitionBy(*group, "fact").orderBy("distance", "other"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k).drop("_length")
    return best if most is None else best.where(F.col("distance") <= most)
