"""Mixing sources to target weights: temperature, bisected; then budgeted block permutations.

A source's weight is its share of tokens to the power t, normalised. The exponent t in 0..1 is
bisected to the least (the flattest mix) that keeps a limit: the repetition of every source is at
most `max_repetition`, or the entropy of the weights is at most `target_entropy`. Without a budget,
the budget is the least for which every source is seen once whole, so no document is left out.

A source with weight w of a budget of B tokens gets w * B of them: whole epochs over all its
documents, and of one more epoch a part. Each epoch permutes the source's blocks of about
`block_rows` documents and the documents in a block, by hash; the part is the longest beginning of
its permutation that the rest of the budget covers. The sums run over blocks, then inside one
block for each source, so no source is gathered in one task.

Tokens are the runs of letters, of digits and of signs, as byte-level tokenizers part a text before
they look anything up; they are counted over whole texts, 1 at least. The counts of a tokenizer,
such as those of token_counts, may be given as a column instead.

Defined results: a null source is a source; a null or empty text counts as one token; repeated
rows are documents of their own, and those that tie at the end of a part are all taken; very long
texts are counted whole; no rows give no rows; other columns stay, whatever their names, but for those of the
names that are added.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import durable, packed, text_of, unpacked

#: Fixed value: what a byte-level tokenizer takes for one pre-token, without the space before it.
PRETOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
#: Bisections made by one job; each job looks at all exponents that so many steps can reach.
STEPS = 6
#: Up to so many sources their plan is broadcast; above, it is joined by a shuffle.
MOST_BROADCAST = 50_000


def tokens(text: str = "text") -> Column:
    """Pre-tokens of the text, 1 at least."""
    return F.greatest(F.regexp_count(text_of(text), F.lit(PRETOKEN)), F.lit(1)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def bisect_exponent(shares: DataFrame, *, max_repetition: float | None, target_entropy: float | None, budget_ratio: float | None, rounds: int = 5) -> float:
    """The least exponent in 0..1 that keeps the limits; 1 if none does.

    shares has p, the share of each source. Each round is one aggregation over the sources.
    """
    low, high = 0.0, 1.0
    for _ in range(rounds):
        n = 2**STEPS
        at = [low + (high - low) * i / n for i in range(n + 1)]
        rows = (
            shares.withColumn("t", F.explode(F.array(*map(F.lit, at))))
            .groupBy("t")
            .agg(
                F.sum(F.exp(F.col("t") * F.log("p"))).alias("z"),
                F.sum(F.exp(F.col("t") * F.log("p")) * F.log("p")).alias("zl"),
                F.max(F.exp((F.col("t") - 1) * F.log("p"))).alias("most"),
                F.min(F.exp((F.col("t") - 1) * F.log("p"))).alias("least"),
            )
            .collect()
        )
        found = {r["t"]: r for r in rows}

        def keeps(t: float) -> bool:
            r = found[t]
            repetition = r["most"] / r["least"] if budget_ratio is None else budget_ratio * r["most"] / r["z"]
            entropy = math.log(r["z"]) - t * r["zl"] / r["z"]
            return (max_repetition is None or repetition <= max_repetition * (1 + 1e-12)) and (target_entropy is None or entropy <= target_entropy + 1e-12)

        if keeps(at[0]):
            return at[0]
        i, j = 0, n
        while j - i > 1:
            k = (i + j) // 2
            i, j = (i, k) if keeps(at[k]) else (k, j)
        low, high = at[i], at[j]
    return high


def _permuted(seed: int, epoch: Column, *what: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, *what)


def plan_sources(docs: DataFrame, *, max_repetition: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, block_rows: int = 4096, seed: int = 17, counts: str | None = None) -> tuple[DataFrame, int]:
    """A row for each source, and the number of them; counts names a column with the tokens of each document.

    The row has _src, weight, _blocks, _whole (epochs seen whole) and the end of the part: order and
    number of its last block, and the order of the last document in it.
    """
    light = durable(docs.select(source_key(F.col("source")).alias("_src"), "doc_id", (tokens() if counts is None else F.greatest(F.coalesce(F.col(counts), F.lit(1)), F.lit(1)).cast("long")).alias("_tokens")))
    sources = durable(light.groupBy("_src").agg(F.sum("_tokens").alias("sum"), F.count(F.lit(1)).alias("n")))
    n, total = sources.agg(F.count(F.lit(1)), F.sum("sum")).first()
    shares = sources.withColumn("p", F.col("sum") / F.lit(float(total or 1)))
    ratio = None if budget is None else budget / (total or 1)
    t = bisect_exponent(shares.select("p"), max_repetition=max_repetition, target_entropy=target_entropy, budget_ratio=ratio) if n else 1.0
    z, least = shares.agg(F.sum(F.exp(t * F.log("p"))), F.min(F.exp((t - 1) * F.log("p")))).first()
    # Repetition of a source: weight * budget / its tokens.
    repetition = F.exp((t - 1) * F.log("p")) * (1.0 / (least or 1.0) if ratio is None else ratio / (z or 1.0))
    planned = (
        shares.withColumn("repetition", repetition)
        .withColumn("weight", F.exp(t * F.log("p")) / F.lit(z or 1.0))
        .withColumn("_whole", F.floor(F.col("repetition") + 1e-9).cast("int"))
        .withColumn("_rest", F.round(F.greatest(F.col("repetition") - F.col("_whole"), F.lit(0.0)) * F.col("sum")).cast("long"))
        .withColumn("_blocks", F.ceil(F.col("n") / block_rows).cast("long"))
        .select("_src", "weight", "repetition", "_whole", "_rest", "_blocks")
    )
    placed = with_plan(light, planned, n).withColumn("_block", block_of(F.col("_blocks"), seed))
    per_block = placed.groupBy("_src", "_block").agg(F.sum("_tokens").alias("sum"), F.first("_whole").alias("_whole"), F.first("_rest").alias("_rest"))
    order = _permuted(seed, F.col("_whole"), F.col("_src"), F.col("_block"))
    up_to = W.partitionBy("_src").orderBy("_end_order", "_block").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = (
        per_block.withColumn("_end_order", order)
        .withColumn("_upto", F.sum("sum").over(up_to))
        # The one block in which the rest runs out.
        .where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("sum") <= F.col("_rest")))
        .select("_src", F.col("_block").alias("_end_block"), "_end_order", (F.col("_rest") - F.col("_upto") + F.col("sum")).alias("_left"))
    )
    inside = (
        with_plan(placed, ends, n)
        .where(F.col("_block") == F.col("_end_block"))
        .withColumn("_doc", _permuted(seed, F.col("_whole"), F.col("doc_id")))
        .withColumn("_upto", F.sum("_tokens").over(W.partitionBy("_src").orderBy("_doc").rangeBetween(W.unboundedPreceding, W.currentRow)))
        .where(F.col("_upto") <= F.col("_left"))
        .groupBy("_src")
        .agg(F.max("_doc").alias("_end_doc"))
    )
    return durable(planned.join(ends, "_src", "left").join(inside, "_src", "left")), n


def block_of(blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), F.col("doc_id")), blocks)


def with_plan(df: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    return df.join(F.broadcast(plan) if n <= MOST_BROADCAST else plan, "_src")


def mix(docs: DataFrame, *, seed: int = 17, **limits) -> DataFrame:
    """A row for each time that a document is seen: docs with epoch, block, block_order, doc_order, weight and repetition.

    In each source, epoch, block_order and doc_order give the order of the mixture.
    """
    plan, n = plan_sources(docs, seed=seed, **limits)
    of = lambda c: F.col("row").getField(c).alias(c)
    held = packed(docs).select("row", of("doc_id"), source_key(F.col("row").getField("source")).alias("_src"))
    placed = with_plan(held, plan, n).withColumn("block", block_of(F.col("_blocks"), seed))
    order = lambda e: _permuted(seed, e, F.col("_src"), F.col("block"))
    doc = lambda e: _permuted(seed, e, F.col("doc_id"))
    last = order(F.col("_whole"))
    before = F.struct(last, F.col("block")) < F.struct(F.col("_end_order"), F.col("_end_block"))
    in_end = (F.col("block") == F.col("_end_block")) & (doc(F.col("_whole")) <= F.col("_end_doc"))
    times = F.col("_whole") + F.when(F.coalesce(before | in_end, F.lit(False)), 1).otherwise(0)
    seen = placed.withColumn("_times", times).where("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    added = {"epoch": F.col("epoch"), "block": F.col("block"), "block_order": order(F.col("epoch")), "doc_order": doc(F.col("epoch")), "weight": F.col("weight"), "repetition": F.col("repetition")}
    return unpacked(seen, docs.columns, added)
