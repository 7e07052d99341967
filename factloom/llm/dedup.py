"""Near-dedup: SetSketch registers, banded; joint estimates by likelihood; links confirmed on full sets.

1. Each document's shingle set gives registers and a digest. Documents with equal sets are one
   class, represented by its smallest doc_id; all later steps see classes only.
2. Bands of registers give buckets. With 32 bands of 5 rows a pair at the threshold of 0.8 shares
   no bucket with a chance of 3 in a million, a pair at 0.85 with 7 in a billion.
3. In a bucket of up to `small` classes every pair is a candidate. In a larger one each class is
   paired with one hub, the class whose buckets are the fullest: it is nearest to what the group
   has in common.
4. Candidates whose sizes and joint estimate allow a link are confirmed on their full sets.
5. Components of these links. A large bucket that still holds more than one component is compared
   in blocks inside tasks, between components only, so that no link is lost and no list of pairs
   is made. Blocks of the bucket's largest component meet those of the others, not each other. Each pair is compared in
   the first band it shares. First registers alone meet, and tell which classes of a pair of blocks have a likely
   partner there; only these are joined with their full sets, and only confirmed links leave a task. A block holds
   BLOCK classes at most, about, and BLOCK_ITEMS shingles, so that long texts make small blocks.
6. Components of all links.

Shingles are held as 64-bit hashes.

Defined results: a text that is null or has no words has an empty set and is linked with nothing;
rows that share a doc_id are one document with several texts, linked with whatever one of them is
linked with; a row without doc_id is counted, linked with nothing, and kept; the smallest of ids that
tie is the component's; very long texts are read whole; no rows give no rows; other columns, whatever
their names, are left out.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import sketch
from factloom.llm.common import durable
from factloom.llm.graph import components

#: Estimates under it are not confirmed; at 0.8 an estimate has a deviation of 0.032.
LOWEST_ESTIMATE = 0.66
SMALL, BLOCK, BLOCK_ITEMS = 32, 1024, 1 << 20
#: Classes of more rows than HOT_ROWS are joined by broadcast: the largest of them, HOT_CLASSES rows of some dozen bytes at most.
#: No class that is left to the shuffle then holds more than one in HOT_CLASSES of all rows.
HOT_ROWS, HOT_CLASSES = 1000, 20_000


def digest_of(shingles: np.ndarray) -> bytes | None:
    """Of a whole set; None for an empty one."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (size of the set), cls (digest of the set; null if it is empty) and regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = sketch.Shingler(size)
        for batch in batches:
            n, cls, regs = [], [], []
            for text in batch.column("text"):
                s = shingler(text.as_py())
                n.append(len(s))
                cls.append(digest_of(s))
                regs.append(sketch.registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "n", "cls", "regs"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, cls binary, regs binary")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and items, its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = sketch.Shingler(size)
        for batch in batches:
            sets = [shingler(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, items array<long>")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """bucket, rep, n: a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, sketch.M)
                keys = np.concatenate([sketch.bands(r) for r in regs])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *(pa.array(np.repeat(batch.column(c).to_numpy(), sketch.BANDS)) for c in ("rep", "n"))],
                    names=["bucket", "rep", "n"],
                )

    return reps.select("rep", "n", "regs").mapInArrow(run, "bucket long, rep long, n long")


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate is high enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.uint16).reshape(-1, sketch.M) for c in ("ra", "rb"))
                yield f.loc[sketch.joint_estimate(x, y, f["na"].to_numpy(), f["nb"].to_numpy()) >= LOWEST_ESTIMATE, ["a", "b"]]

    of = lambda end: reps.select(F.col("rep").alias(end), F.col("regs").alias(f"r{end}"), F.col("n").alias(f"n{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(run, "a long, b long")


def linked(common, na, nb, percent: int):
    """100 * intersection >= percent * union."""
    return 100 * common >= percent * (na + nb - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked on their full sets, as edges (u, v)."""
    of = lambda end: sets.select(F.col("doc_id").alias(end), F.col("items").alias(f"s{end}"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(of("a"), "a")
        .join(of("b"), "b")
        .where(linked(common, F.size("sa"), F.size("sb"), percent))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _likely(rows: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows of another component that its registers are like, each pair in the first band it shares."""
    regs = np.frombuffer(b"".join(rows["regs"]), np.uint16).reshape(-1, sketch.M)
    keys = np.stack([sketch.bands(r) for r in regs])
    n, comp, blk = (rows[c].to_numpy() for c in ("n", "comp", "blk"))
    bucket, across = rows["bucket"].iat[0], rows["block_a"].iat[0] != rows["block_b"].iat[0]
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        if across:
            j = j[blk[j] != blk[i]]
        if len(j):
            same = keys[j] == keys[i]
            j = j[keys[i][same.argmax(axis=1)] == bucket]
        if len(j):
            j = j[(regs[j] == regs[i]).mean(axis=1) >= LOWEST_ESTIMATE - 0.1]
        if len(j):
            est = sketch.joint_estimate(np.broadcast_to(regs[i], (len(j), sketch.M)), regs[j], np.full(len(j), n[i]), n[j])
            j = j[est >= LOWEST_ESTIMATE]
        if len(j):
            yield i, j


def block_partners(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of one pair of blocks of a bucket (block_a, block_b) that have a likely partner in it."""
    wanted = np.zeros(len(rows), bool)
    for i, j in _likely(rows, percent):
        wanted[i] = wanted[j] = True
    return rows.loc[wanted, ["bucket", "rep", "comp", "blk", "block_a", "block_b"]]


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components in one pair of blocks of a bucket, confirmed on full sets."""
    rep, n, out = rows["rep"].to_numpy(), rows["n"].to_numpy(), []
    for i, j in _likely(rows, percent):
        own = np.asarray(rows["items"].iat[i])
        for k in j:
            if linked(len(np.intersect1d(own, np.asarray(rows["items"].iat[k]), assume_unique=True)), n[i], n[k], percent):
                out.append((rep[i], rep[k]))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each of docs (doc_id, text)."""
    return near_rows(docs, size=size, percent=percent).drop("digest")


def near_rows(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """What near_duplicates gives, and digest, that of the row's set (null if it is empty).

    size is the words of a shingle, percent the similarity of a link in hundredths.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = durable(signatures(docs, size))
    reps = durable(
        signed.where("cls IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("cls")
        .agg(F.min(F.struct("doc_id", "n", "regs")).alias("m"), F.count(F.lit(1)).alias("copies"))
        .select("cls", F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.regs").alias("regs"), "copies")
    )
    rows = bucket_rows(reps)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    multi = durable(rows.join(sizes, "bucket"))

    few = multi.where(F.col("size") <= SMALL)
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    a, b = few.select("bucket", F.col("rep").alias("a"), F.col("n").alias("x")), few.select("bucket", F.col("rep").alias("b"), F.col("n").alias("y"))
    pairs = a.join(b, "bucket").where((F.col("a") < F.col("b")) & near(F.col("x"), F.col("y"))).select("a", "b")

    many = multi.where(F.col("size") > SMALL)
    weight = many.groupBy("rep").agg(F.sum("size").alias("weight"))
    hubs = (
        many.join(weight, "rep")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), F.col("n").alias("hub_n"))).alias("h"))
        .select("bucket", (-F.col("h.minus")).alias("hub"), F.col("h.hub_n").alias("hub_n"))
    )
    stars = (
        many.join(hubs, "bucket")
        .where((F.col("rep") != F.col("hub")) & near(F.col("n"), F.col("hub_n")))
        .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    )
    likely = durable(estimated(pairs.union(stars).distinct(), reps))
    ends = likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).union(many.select(F.col("rep").alias("doc_id"))).distinct()
    wanted = docs.join(ends, "doc_id", "left_semi")
    sets = durable(shingle_sets(wanted, size))
    first = durable(confirmed(likely, sets, percent))

    labels = components(first)
    labelled = (
        many.join(labels, many["rep"] == labels["node"], "left")
        .select("bucket", "rep", "n", "size", F.coalesce("component", "rep").alias("comp"))
    )
    # The largest component of a bucket is its main one; its classes need not meet each other.
    counted = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"))
    parts = lambda c, items: F.greatest(F.ceil(c / BLOCK), F.ceil(items / BLOCK_ITEMS)).cast("int")
    open_buckets = (
        counted.groupBy("bucket")
        .agg(F.max(F.struct("m", (-F.col("comp")).alias("minus"), "items")).alias("top"), F.sum("m").alias("all"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1")
        .select("bucket", (-F.col("top.minus")).alias("main"), parts(F.col("top.m"), F.col("top.items")).alias("mains"), parts(F.col("all") - F.col("top.m"), F.col("items") - F.col("top.items")).alias("rests"))
    )
    is_main, h = F.col("comp") == F.col("main"), F.xxhash64("rep")
    blk = F.when(is_main, F.pmod(h, F.col("mains"))).otherwise(F.col("mains") + F.pmod(h, F.col("rests"))).cast("int")
    others = F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("rests") - 1)
    placed = (
        labelled.join(open_buckets, "bucket")
        .select("bucket", "rep", "comp", blk.alias("blk"), F.explode(others).alias("other"))
        .select("bucket", "rep", "comp", "blk", F.least("blk", "other").alias("block_a"), F.greatest("blk", "other").alias("block_b"))
    )
    registers, met = reps.select("rep", "n", "regs"), ("bucket", "block_a", "block_b")
    partners = durable(
        placed.join(registers, "rep").groupBy(*met).applyInPandas(lambda f: block_partners(f, percent), "bucket long, rep long, comp long, blk int, block_a int, block_b int")
    )
    whole = partners.join(registers, "rep").join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")
    second = whole.groupBy(*met).applyInPandas(lambda f: block_links(f, percent), "u long, v long")
    final = components(first.union(second))

    return labelled_rows(signed, reps, final)


def labelled_rows(signed: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """The result: each signed row with the component of its class; rows without a class or an id have none to look up.

    A class of many rows would meet in one task, so the largest are joined by broadcast.
    """
    of_class = reps.join(labels, F.col("rep") == F.col("node"), "left").select("cls", "copies", F.coalesce("component", "rep").alias("c"))
    hot = of_class.where(F.col("copies") > HOT_ROWS).orderBy(F.desc("copies"), "cls").limit(HOT_CLASSES).select("cls", F.col("c").alias("hot"))
    bare = signed.select("doc_id", "n", "cls")
    known = F.col("cls").isNotNull() & F.col("doc_id").isNotNull()
    marked = bare.where(known).join(F.broadcast(hot), "cls", "left")
    rows = (
        bare.where(~known).withColumn("c", F.col("doc_id"))
        .unionByName(marked.where("hot IS NOT NULL").withColumnRenamed("hot", "c"))
        .unionByName(marked.where("hot IS NULL").drop("hot").join(of_class.select("cls", "c"), "cls"))
    )
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("c").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"),
        F.col("cls").alias("digest"),
    )


def with_digest(docs: DataFrame, size: int) -> DataFrame:
    """docs, all columns, with the digest that near_rows gives them; for the few rows whose doc_id is not their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = sketch.Shingler(size)
        for batch in batches:
            sets = [shingler(t.as_py()) for t in batch.column("text")]
            digests = pa.array([digest_of(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, "digest"])

    return docs.drop("digest").mapInArrow(run, docs.drop("digest").schema.add("digest", "binary"))


def one_of_each(docs: DataFrame, near: DataFrame, size: int) -> DataFrame:
    """docs (doc_id a long) without what near, a result of near_rows over them, does not keep.

    A row that is repeated stays once. Different texts of one doc_id are one document, told apart by
    their digests: each goes if it is alike to a smaller id's, else it stays. Rows without doc_id all stay.
    """
    near = near.where("doc_id IS NOT NULL")
    odd = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(~F.col("kept")).alias("gone")).where("rows > 1 OR gone")
    plain = docs.join(odd.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    shared = odd.where("rows > 1").select("doc_id")
    if shared.isEmpty():
        return plain
    told = with_digest(docs.join(shared, "doc_id", "left_semi").select(*docs.columns), size)
    same = F.coalesce("digest", F.lit(b"")).alias("digest")
    kept = near.where("kept").select("doc_id", same).distinct()
    rest = told.withColumn("digest", same).join(kept, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return plain.unionByName(rest.select(*docs.columns))
