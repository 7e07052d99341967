"""Centroid clustering of whole-number vectors with Drake's adaptive bounds, exact to the last tie.

Each vector keeps its centroid, an upper bound of the distance to it, the lower bounds of the distances to its next
several centroids, nearest first, and one lower bound for all the rest. When centroids move, bounds move by as much.
A centroid is certain while its upper bound is strictly below all others; else its distance is taken exactly, and only
the nearest centroids, up to the first place from which on all bounds lie above, are scanned again; if there is no such place,
all of them are. Bounds are loosened by more than what doubles can err, and distances that decide are whole numbers, so ties go
to the smaller number as they would by a full scan. The number of bounds falls to what the last round made use of.

On Spark: the vectors are written once, in a table bucketed by row; the bounds are a narrow table in the same
buckets, written anew each round, so that the two meet without a shuffle and vectors are never written again. A row that changes
its centroid carries its vector in the bounds' table; sums are kept up by these rows alone, as exact integers. Only the centroids and their
sums (k times the length of a vector) reach the driver. The tables lie in the shared folder and are dropped once the result is
written there; a lost executor costs the tasks it ran.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; components
are held to 2**53 either way, and distances to the range of a long. Repeated rows are vectors each. Fewer vectors than centroids
make fewer centroids; an empty centroid stays where it is. No rows give no rows; other columns are left out.
"""

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import durable
from factloom.sources.shared import remove_folder, shared_folder

#: Rows of a bucket, about, at most and at least; rows that are scanned at once; what bounds are loosened by.
BUCKET, LEAST_BUCKET, ROWS, LOOSE = 200_000, 2_048, 4_096, 1e-12
FAR = 1 << 53
STATE = "row long, own int, was int, high double, near array<int>, low array<double>, rest double, used int, moved array<long>"


def whole_vectors(embeddings: DataFrame, *, scale: int = 1024, length: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * x) of every component, of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = embeddings.where(F.col("embedding").isNotNull()).where((F.size("embedding") == length) & ~F.coalesce(bad, F.lit(True)))
    held = lambda x: F.greatest(F.lit(float(-FAR)), F.least(F.lit(float(FAR)), F.floor(x.cast("double") * scale).cast("double")))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: held(x).cast("long")).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to its own centroids, c[row, j]; Python's integers where 64 bits are too short."""
    if not x.size:
        return np.zeros(c.shape[:2], np.int64)
    if x.shape[1] * (2 * int(max(np.abs(x).max(), np.abs(c).max()))) ** 2 >= 2**62:
        x, c = x.astype(object), c.astype(object)
    return ((x[:, None, :] - c) ** 2).sum(axis=2)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def ranked(x: np.ndarray, centres: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of each row by distance, ties by number, and the distances."""
    ids = np.sort(ids, axis=1)
    d = squared(x, centres[ids])
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), root(np.take_along_axis(d, order, axis=1))


class Bounds:
    """The bounds of some vectors, as arrays: own, high, near, low, rest; used is the place that made each certain."""

    def __init__(self, own, high, near, low, rest):
        self.own, self.high, self.near, self.low, self.rest = own, high, near, low, rest
        self.used = np.zeros(len(own), np.int32)

    @classmethod
    def fresh(cls, x: np.ndarray, centres: np.ndarray, b: int) -> "Bounds":
        n = len(x)
        out = cls(np.zeros(n, np.int64), np.zeros(n), np.zeros((n, b), np.int64), np.zeros((n, b)), np.zeros(n))
        out._scan_all(x, centres, np.arange(n))
        return out

    def _scan_all(self, x, centres, rows) -> None:
        b, k = self.near.shape[1], len(centres)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            ids, d = ranked(x[some], centres, np.broadcast_to(np.arange(k), (len(some), k)))
            self.own[some], self.high[some] = ids[:, 0], d[:, 0] * (1 + LOOSE)
            self.near[some], self.low[some] = ids[:, 1 : b + 1], d[:, 1 : b + 1] * (1 - LOOSE)
            self.rest[some] = d[:, b + 1] * (1 - LOOSE) if k > b + 1 else np.inf
        self.used[rows] = b + 1

    def narrowed(self, b: int) -> None:
        """Keeps b bounds; the others join the rest."""
        if b < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(axis=1))
            self.near, self.low = self.near[:, :b], self.low[:, :b]

    def assign(self, x: np.ndarray, centres: np.ndarray, moves: np.ndarray) -> None:
        """The nearest of the centres, which moved by `moves` since the bounds were taken."""
        b = self.near.shape[1]
        less = lambda bound, move: bound - move - LOOSE * (np.abs(bound) + move)
        self.high = (self.high + moves[self.own]) * (1 + LOOSE)
        self.low = less(self.low, moves[self.near])
        with np.errstate(invalid="ignore"):
            self.rest = np.where(np.isinf(self.rest), self.rest, less(self.rest, moves.max()))
        # A lower bound of all centroids at this place and behind it.
        behind = np.minimum.accumulate(np.column_stack([self.low, self.rest])[:, ::-1], axis=1)[:, ::-1]
        self.used = np.zeros(len(x), np.int32)
        unsure = np.nonzero(~(self.high < behind[:, 0]))[0]
        for at in range(0, len(unsure), ROWS):
            some = unsure[at : at + ROWS]
            self.high[some] = root(squared(x[some], centres[self.own[some]][:, None, :])[:, 0]) * (1 + LOOSE)
        above = self.high[unsure, None] < behind[unsure]
        place = np.where(above.any(axis=1), above.argmax(axis=1), b + 1)
        for j in range(1, b + 1):
            rows = unsure[place == j]
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                ids, d = ranked(x[some], centres, np.column_stack([self.own[some], self.near[some, :j]]))
                self.own[some], self.high[some] = ids[:, 0], d[:, 0] * (1 + LOOSE)
                self.near[some, :j], self.low[some, :j] = ids[:, 1:], d[:, 1:] * (1 - LOOSE)
            self.used[rows] = j
        self._scan_all(x, centres, unsure[place == b + 1])


def _numbers(column: pa.Array, kind, n: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = np.array(column.flatten().to_numpy(zero_copy_only=False), kind)
    return flat.reshape(n, len(flat) // n)


def _lists(m: np.ndarray, kind: pa.DataType, there: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as lists; null where not there."""
    there = np.ones(len(m), bool) if there is None else there
    ends = np.concatenate([[0], np.cumsum(there * m.shape[1])])
    mask = None if there.all() else pa.array(~there)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(m[there].ravel(), kind), mask=mask)


def _state(rows: pa.Array, s: Bounds, was: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    arrays = [
        rows, pa.array(s.own, pa.int32()), pa.array(was, pa.int32()), pa.array(s.high), _lists(s.near, pa.int32()), _lists(s.low, pa.float64()),
        pa.array(s.rest), pa.array(s.used, pa.int32()), _lists(x, pa.int64(), s.own != was),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["row", "own", "was", "high", "near", "low", "rest", "used", "moved"])


class _Tables:
    """Tables in one folder, bucketed alike by row."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.name = spark, buckets, f"clusters_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.bucketBy(self.buckets, "row").option("path", f"{self.folder}/{name}").saveAsTable(f"{self.name}_{name}")
        return self.spark.table(f"{self.name}_{name}")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{name}")
        remove_folder(self.spark, f"{self.folder}/{name}")


def moved_sums(state: DataFrame) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each centroid, by 1 for vectors that came and -1 for those that went: their number and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column("moved"), np.int64, batch.num_rows)
            safe = int(np.abs(x).max()) * len(x) < 2**62
            for sign, name in ((1, "own"), (-1, "was")):
                c = batch.column(name).to_numpy()
                for one in np.unique(c[c >= 0]):
                    part = x[c == one]
                    have = total.setdefault((int(one), sign), [0, np.zeros(x.shape[1], object)])
                    have[0] += len(part)
                    have[1] += part.sum(axis=0).astype(object) if safe else part.astype(object).sum(axis=0)
        rows = [(c, sign, n, i, str(v)) for (c, sign), (n, sums) in total.items() for i, v in enumerate(sums)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["c", "sign", "n", "i", "v"])

    parts = state.where("moved IS NOT NULL").select("own", "was", "moved").mapInArrow(run, "c int, sign int, n long, i int, v string")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in parts.groupBy("c", "sign", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("c", "sign", "i").collect():
        out.setdefault((r["c"], r["sign"]), (r["n"], []))[1].append(int(r["v"]))
    return out


def first_centres(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of `seed:vec_id`, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.orderBy(h.asc_nulls_last(), "v").limit(k).select("v").collect()]


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, bounds: int = 3, bucket: int | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster and distance, squared, of vectors (vec_id, v), all v of one length; the centroids after all rounds)."""
    spark = vectors.sparkSession
    centres = first_centres(vectors, k, seed)
    if not centres:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    n = vectors.count()
    if bucket is None:
        bucket = min(BUCKET, max(LEAST_BUCKET, n // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tables = _Tables(spark, -(-n // bucket))
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    rows = tables.write(numbered.repartition(tables.buckets, "row"), "vectors")
    b = max(0, min(bounds, len(centres) - 1))
    whole = lambda c: np.array(c, np.int64)

    def begin(batches: Iterator[pa.RecordBatch], at=whole(centres), b=b) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _numbers(batch.column("v"), np.int64, batch.num_rows)
                yield _state(batch.column("row"), Bounds.fresh(x, at, b), np.full(len(x), -1), x)

    def step(at: np.ndarray, moves: np.ndarray, b: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    m, of = batch.num_rows, lambda c: np.array(batch.column(c).to_numpy(zero_copy_only=False))  # noqa: B023
                    x, was = _numbers(batch.column("v"), np.int64, m), of("own").astype(np.int64)
                    s = Bounds(was.copy(), of("high"), _numbers(batch.column("near"), np.int64, m), _numbers(batch.column("low"), np.float64, m), of("rest"))
                    s.narrowed(b)
                    s.assign(x, at, moves)
                    yield _state(batch.column("row"), s, was, x)

        return run

    def met(state: DataFrame) -> DataFrame:
        """Bucket by bucket: the state of a bucket is the small side."""
        return rows.join(state.drop("was", "moved").hint("shuffle_hash"), "row")

    state, last = tables.write(rows.select("row", "v").mapInArrow(begin, STATE), "bounds_0"), "bounds_0"
    many, sums = [0] * len(centres), [[0] * len(centres[0]) for _ in centres]
    for r in range(1, rounds + 1):
        for (c, sign), (count, v) in moved_sums(state).items():
            many[c] += sign * count
            sums[c] = [a + sign * x for a, x in zip(sums[c], v)]
        now = [[s // m for s in total] if m else old for total, m, old in zip(sums, many, centres)]
        moves = np.array([math.sqrt(sum((a - o) ** 2 for a, o in zip(new, old))) for new, old in zip(now, centres)])
        centres = now
        if not moves.any():
            break  # no later round can change anything
        if r > 1:
            used = state.where(F.col("used") <= b).agg(F.max("used")).first()[0]
            b = min(b, max(1, used or 0)) if b else 0
        state = tables.write(met(state).mapInArrow(step(whole(centres), moves * (1 + LOOSE), b), STATE), f"bounds_{r}")
        tables.drop(last)
        last = f"bounds_{r}"

    def measure(batches: Iterator[pa.RecordBatch], at=whole(centres)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, own = _numbers(batch.column("v"), np.int64, batch.num_rows), batch.column("own").to_numpy()
                d = np.concatenate([squared(x[i : i + ROWS], at[own[i : i + ROWS]][:, None, :])[:, 0] for i in range(0, len(x), ROWS)])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("own"), pa.array(np.minimum(d, 2**63 - 1).astype(np.int64))], names=["vec_id", "cluster", "distance"])

    placed = durable(rows.join(state.select("row", "own").hint("shuffle_hash"), "row").select("vec_id", "v", "own").mapInArrow(measure, "vec_id long, cluster int, distance long"))
    for name in ("vectors", last):
        tables.drop(name)
    remove_folder(spark, tables.folder)
    return placed, centres


def inertias(placed: DataFrame) -> dict[int, int]:
    """The sum of distances of each centroid's vectors; a row for each centroid reaches the driver."""
    return {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
