"""Exact top-k search by inner product: a kNN join over the Voronoi cells of pivots.

1. Pivots are taken from the data (vectors with the smallest hashes), about as many as the square
   root of its rows. Each vector goes to the cell of its nearest pivot, with its distance to it.
2. A cell's summary is the number and the largest distance of the vectors in each of its rings (distances alike). For a
   query q and an x at distance a from pivot p, q.p - |q| a <= q.x <= q.p + |q| a.
3. A query's threshold is the k-th largest score that the lower bounds of the rings warrant, rows
   of its own vec_id not counted. An x can be wanted only if its distance a is at least
   (threshold - q.p) / |q|.
4. Queries are grouped by their cells, cells near each other together, in groups of about
   `block_queries`; a hot cell is many groups. A group needs of each cell the vectors whose distance is at least the
   least that one of its queries asks for. Only those are copied to it; a cell that is not asked moves no row.
5. What a group needs is dealt into blocks of about `block_rows` by hash, its queries are copied
   to each block; a block is solved in one task with a matrix product, and the best k of a query
   over its blocks are its result.
6. Where the bounds leave out little (groups need more than MERGE of all rows on average), small groups would
   copy the vectors often for nothing: groups are then merged, up to as many queries as fill MERGED bytes, and blocks are
   of that size too, so that neither side is copied more often than a task's memory asks for.

Only pivots and summaries reach the driver; their number is the parameter n_pivots. How much is
left out depends on the data: clustered vectors leave most cells unasked; of vectors spread evenly
over a sphere of many dimensions exact bounds leave out little.

Components are whole numbers held as doubles. Products are exact: in doubles while they stay
under 2**53, in Python's integers beyond; scores are held to the range of a long.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
a query meets the vectors of its own length, and each length is searched by itself (lengths are few). A repeated vec_id is as
many candidates; as a query it counts once, with its smallest vector. Ties go to the smaller
vec_id. Fewer than k candidates are all returned. No rows give no rows; other columns are left out.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import durable

#: Up to so many rows, of a few dozen bytes each, the asked distances are broadcast; above, they are joined by a salted shuffle.
MOST_BROADCAST = 200_000
#: Vectors of a cell that meet its asked distances in one salted group, about.
SALTED = 100_000
#: Rings of a cell for each doubling of the distance, and the highest of them.
PER_OCTAVE, LAST_RING = 8, 400
#: Share of the rows that groups need from which on they are merged, and bytes of a merged group's vectors, about.
MERGE, MERGED = 0.5, 1 << 24


def whole_vectors(embeddings: DataFrame, *, scale: int = 1024) -> DataFrame:
    """vec_id and v, floor(scale * x) of every component, of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where((F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))
    return good.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers."""
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def best_of(queries: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of data for each query: query_id, vec_id, score."""
    if not len(queries) or not len(data):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    ids = data["vec_id"].to_numpy()
    x, out = _matrix(data["v"]), []
    for at in range(0, len(queries), 256):
        some = queries.iloc[at : at + 256]
        s = scores(_matrix(some["v"]), x)
        for query, row in zip(some["query_id"].to_numpy(), s):
            others = np.nonzero(ids != query)[0]
            if len(others) > k:
                own = row[others]
                others = others[own >= np.partition(own, len(own) - k)[len(own) - k]]
            order = np.lexsort((ids[others], ~row[others]))[:k]  # ~ turns the order round without overflow
            pick = others[order]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[pick], "score": row[pick]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def choose_pivots(vectors: DataFrame, n_pivots: int | None) -> np.ndarray:
    """Distinct vectors with the smallest hashes; about the square root of the rows, 32 to 1024, if no number is given."""
    most = n_pivots or min(1024, max(32, math.isqrt(vectors.count())))
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(4 * most).collect()
    found = list(dict.fromkeys(tuple(r["v"]) for r in chosen))[:most]
    return np.array(found, np.float64) if found else np.zeros((1, 1))


def place(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with cell (its nearest pivot), apart (the distance to it) and copy, which tells equal rows of a batch apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (pivots**2).sum(axis=1) / 2
        for f in frames:
            if len(f):
                x = _matrix(f["v"])
                cell = (half[None, :] - x @ pivots.T).argmin(axis=1)
                yield f.assign(cell=cell.astype("int32"), apart=np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)), copy=np.arange(len(f), dtype="int32"))

    return vectors.select("vec_id", "v").mapInPandas(run, "vec_id long, v array<double>, cell int, apart double, copy int")


def chain(pivots: np.ndarray, cells: list[int]) -> list[int]:
    """The cells, each followed by the nearest one that is left."""
    left, out = list(cells[1:]), list(cells[:1])
    while left:
        apart = ((pivots[left] - pivots[out[-1]]) ** 2).sum(axis=1)
        out.append(left.pop(int(apart.argmin())))
    return out


def group_cells(pivots: np.ndarray, many: dict[int, int], block_queries: int) -> tuple[list[int], list[int]]:
    """For each cell the group of its queries, and the parts that the group is split into."""
    group, parts, now, filled = [0] * len(pivots), [1] * len(pivots), 0, 0
    for cell in chain(pivots, sorted(many)):
        if filled and filled + many[cell] > block_queries:
            now, filled = now + 1, 0
        group[cell], parts[cell] = now, -(-many[cell] // block_queries)
        filled += many[cell]
    return group, parts


@dataclass
class Routed:
    """placed: all vectors; queries: grp, part, query_id, v; asks: grp, part, cell, least (the smallest distance asked for).

    rings: cell, radius, n; cells: the number of vectors of each.
    """

    placed: DataFrame
    queries: DataFrame
    asks: DataFrame
    rings: DataFrame
    cells: dict[int, int]


def route(vectors: DataFrame, is_query: Column, *, k: int = 10, n_pivots: int | None = None, block_queries: int = 1024) -> Routed:
    """What each group of queries asks of each cell."""
    spark = vectors.sparkSession
    pivots = choose_pivots(vectors, n_pivots)
    placed = durable(place(vectors, pivots))
    ring = F.when(F.col("apart") > 0, F.least(F.greatest(F.ceil(PER_OCTAVE * F.log2("apart")), F.lit(0)), F.lit(LAST_RING))).otherwise(-1)
    rings = [tuple(r) for r in placed.groupBy("cell", ring.alias("ring")).agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")).collect()]
    ring_cell, radius, many = (np.array([r[i] for r in rings], kind) for i, kind in ((0, np.int64), (2, np.float64), (3, np.int64)))
    widest = np.full(len(pivots), -1.0)
    np.maximum.at(widest, ring_cell, radius)

    own = placed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))
    asking = durable(placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q")).join(own, "vec_id").select("vec_id", "q.v", "q.cell", "own"))
    asked = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}
    group, parts = group_cells(pivots, asked, block_queries)
    of = lambda values: F.get(F.from_json(F.lit(str(values)), "array<int>"), F.col("cell"))
    grouped = asking.withColumns({"grp": of(group), "part": F.pmod(F.xxhash64("vec_id"), of(parts)).cast("int")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                some = f.iloc[at : at + 512]
                q, need = _matrix(some["v"]), k + some["own"].to_numpy()
                middle, size = q @ pivots.T, np.sqrt((q**2).sum(axis=1))[:, None]
                slack = 1e-9 * (np.abs(middle) + size * np.maximum(widest, 0)[None, :]) + 1e-6
                low = (middle - slack)[:, ring_cell] - size * radius[None, :]
                order = np.argsort(-low, axis=1, kind="stable")
                enough = np.cumsum(many[order], axis=1) >= need[:, None]  # of them so many as `own` may have the query's own vec_id
                threshold = np.where(enough.any(axis=1), np.take_along_axis(low, order, axis=1)[np.arange(len(low)), enough.argmax(axis=1)], -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(size > 0, (threshold[:, None] - middle - slack) / size, -np.inf)
                least[least > widest[None, :]] = np.inf
                for key, rows in some.reset_index(drop=True).groupby(["grp", "part"]).indices.items():
                    lowest = least[rows].min(axis=0)
                    cells = np.nonzero(lowest < np.inf)[0]
                    yield pd.DataFrame({"grp": key[0], "part": key[1], "cell": cells, "least": lowest[cells]}).astype({"grp": "int32", "part": "int32", "cell": "int32"})

    asks = grouped.mapInPandas(run, "grp int, part int, cell int, least double").groupBy("grp", "part", "cell").agg(F.min("least").alias("least"))
    sizes: dict[int, int] = {}
    for cell, n in zip(ring_cell.tolist(), many.tolist()):
        sizes[cell] = sizes.get(cell, 0) + n
    ring_rows = spark.createDataFrame([(int(c), float(r), int(n)) for c, r, n in zip(ring_cell, radius, many)], "cell int, radius double, n long")
    return Routed(placed, grouped.select("grp", "part", F.col("vec_id").alias("query_id"), "v"), durable(asks), ring_rows, sizes)


def blocks_of(r: Routed, block_rows: int) -> DataFrame:
    """grp, part, blocks: into how many blocks what a group needs is dealt; the rings tell how much that is at most."""
    many = r.asks.join(F.broadcast(r.rings), "cell").where("radius >= least").groupBy("grp", "part").agg(F.sum("n").alias("n"))
    return many.select("grp", "part", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))


def copied(r: Routed, blocks: DataFrame) -> DataFrame:
    """grp, part, blk, vec_id, v: a row for each group that needs a vector."""
    asks = r.asks.join(blocks.drop("n"), ["grp", "part"]).withColumnRenamed("cell", "_cell")
    wanted = (F.col("cell") == F.col("_cell")) & (F.col("apart") >= F.col("least"))
    row = F.xxhash64("vec_id", "v", "copy")
    if r.asks.count() <= MOST_BROADCAST:
        met = r.placed.join(F.broadcast(asks), wanted)
    else:
        salts = F.from_json(F.lit(str([-(-r.cells.get(c, 0) // SALTED) or 1 for c in range(max(r.cells) + 1)])), "array<int>")
        spread = asks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.get(salts, F.col("_cell")) - 1)))
        salted = r.placed.withColumn("salt", F.pmod(row, F.get(salts, F.col("cell"))).cast("int"))
        met = salted.join(spread, wanted & (F.col("salt") == F.col("_salt")))
    return met.select("grp", "part", F.pmod(row, F.col("blocks")).cast("int").alias("blk"), "vec_id", "v")


def merged(r: Routed, groups: int) -> Routed:
    """The same with so many groups, dealt by hash."""
    into = F.pmod(F.xxhash64("grp", "part"), F.lit(groups)).cast("int")
    own = lambda df: df.withColumn("grp", into).withColumn("part", F.lit(0))
    asks = own(r.asks).groupBy("grp", "part", "cell").agg(F.min("least").alias("least"))
    return Routed(r.placed, own(r.queries), durable(asks), r.rings, r.cells)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, n_pivots: int | None = None, block_rows: int = 8192, block_queries: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each of vectors (vec_id, v) that is_query holds for, its best k others."""
    lengths = sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect())
    given = {"k": k, "n_pivots": n_pivots, "block_rows": block_rows, "block_queries": block_queries}
    found = [_top_k(vectors.where(F.size("v") == n), n, is_query, **given) for n in lengths] or [_top_k(vectors, 1, is_query, **given)]
    if len(found) == 1:
        return found[0]
    # An id that stands in several lengths is a query in that of its smallest vector alone.
    own = vectors.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.size(F.min("v")).alias("_length"))
    of = [f.withColumn("_length", F.lit(n)) for f, n in zip(found, lengths)]
    return reduce(DataFrame.unionByName, of).join(own, ["query_id", "_length"], "left_semi").drop("_length")


def _top_k(vectors: DataFrame, length: int, is_query: Column, *, k: int, n_pivots: int | None, block_rows: int, block_queries: int) -> DataFrame:
    routed = route(vectors, is_query, k=k, n_pivots=n_pivots, block_queries=block_queries)
    blocks, keys = durable(blocks_of(routed, block_rows)), ("grp", "part", "blk")
    needed, groups = blocks.agg(F.sum("n"), F.count(F.lit(1))).first()
    most = max(1, MERGED // (8 * length * block_queries))  # groups that one merged group takes up
    if groups > 1 and most > 1 and needed > MERGE * groups * sum(routed.cells.values()):
        routed = merged(routed, -(-groups // most))
        blocks = durable(blocks_of(routed, max(block_rows, MERGED // (8 * length))))
    wanted = routed.queries.join(blocks, ["grp", "part"]).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, "query_id", "v")
    found = wanted.groupBy(*keys).cogroup(copied(routed, blocks).groupBy(*keys)).applyInPandas(lambda q, x: best_of(q, x, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
