"""Best-fit packing of whole tokenised documents into sequences of a fixed capacity.

Every document is tokenised and closed with an end id. One longer than the capacity is cut into
pieces, of which only the first may be shorter. The histogram of lengths, whose size is the
capacity whatever the input, is packed by packing_plan; each piece then takes the place that its
rank among the pieces of its length has in the plan. Ranks are counted in salted parts of a length,
so that a length that most pieces share does not meet in one task.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their
own; no rows give no rows; other columns are left out.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import durable
from factloom.llm.packing_plan import plan
from factloom.llm.pretokens import encoder

#: Pieces of one length that are ranked in one group, about.
GROUP = 20_000


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                out: list[list] = [[], [], [], [], []]
                for doc, raw in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                    raw += end
                    n = len(raw) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        for col, v in zip(out, (doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))):
                            col.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def ranked(cut: DataFrame, largest: int) -> DataFrame:
    """cut with rank, from 0, among the pieces of its length; largest is how many the commonest length has."""
    salts = max(1, -(-largest // GROUP))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    base = (
        salted.groupBy("length", "_salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("_inside", inside).join(base, ["length", "_salt"]).withColumn("rank", F.col("_base") + F.col("_inside") - 1)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, rounds: int = 8) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of docs (doc_id, text)."""
    cut = durable(pieces(docs, tokenizer, capacity=capacity, end_id=end_id))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    runs, _ = plan(counts, capacity, rounds)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    upto = np.cumsum(runs[:, 1])
    first = upto - runs[:, 1]
    of_length = np.searchsorted(runs[:, 0], np.arange(capacity + 2))  # where each length's runs begin
    base = np.concatenate([first, upto[-1:], [0]])[np.minimum(of_length, len(runs))] if len(runs) else np.zeros(capacity + 2, np.int64)
    begin, sequence, offset = first, runs[:, 2], runs[:, 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = base[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
            k = np.searchsorted(begin, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[k] + at - begin[k]), pa.array(offset[k])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked(cut, int(counts.max())).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
