"""An approximate index of embeddings: layered neighbour graphs by cosine distance, one for each shard, kept as rows.

A group's facts (those of a project and kind, say) are dealt into shards of a bounded number of rows. A shard is built in one task: its nodes
are linked to near ones on layers that thin out by a factor of M each, so that a search comes down from few far links to
many near ones. A node is a row: its shard, key, embedding and, for each of its layers, the keys of its neighbours; such
rows are what is written as Parquet and read again.

A search copies each query to the shards of its group, looks into each with a beam of bounded width, and merges what they find: a
query costs a few hundred distances a shard. New facts go into the shard of their group that has room, or into new
ones; the other shards are not touched. `candidates.nearest` is exact and stays beside it.

Embeddings that are null, empty or hold null or non-finite components take no part; in a group all are of one length. Ties go to
the smaller key.
"""

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.sources.shared import durable

#: Links of a node on a layer (twice as many on the lowest), and the width of the beam.
M, EF = 16, 64
SHARD = 4096
#: Rows of the shards that a task searches together, about; queries whose distances it holds at once; tasks at most.
TOGETHER, QUERIES, MOST_TASKS = 8192, 1024, 4096


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m**2).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class Layers:
    """The graph of one shard, while a task holds it."""

    def __init__(self, ids: Iterable, embeddings: Iterable):
        self.ids = list(ids)
        self.x = _unit(np.stack([np.asarray(e, np.float64) for e in embeddings]))
        self.links: list[list[list[int]]] = [[] for _ in self.ids]  # of each node, by layer
        self.entry: int | None = None

    @classmethod
    def of_rows(cls, rows: pd.DataFrame) -> "Layers":
        out = cls(rows["id"], rows["embedding"])
        at = {i: n for n, i in enumerate(out.ids)}
        out.links = [[[at[i] for i in layer] for layer in node] for node in rows["links"]]
        out.entry = max(range(len(out.ids)), key=lambda n: len(out.links[n]))
        return out

    def rows(self) -> pd.DataFrame:
        named = [[[self.ids[n] for n in layer] for layer in node] for node in self.links]
        return pd.DataFrame({"id": self.ids, "links": named})

    def beam(self, q: np.ndarray, begin: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The nearest nodes that a beam finds on a layer, as (distance, node), nearest first."""
        seen, ahead = {n for _, n in begin}, list(begin)
        heapq.heapify(ahead)
        best = [(-d, -n) for d, n in begin]
        heapq.heapify(best)
        while ahead:
            d, n = heapq.heappop(ahead)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [m for m in self.links[n][layer] if m not in seen]
            seen.update(new)
            for e, m in zip((1 - self.x[new] @ q).tolist(), new):
                if len(best) < width or (-e, -m) > best[0]:
                    heapq.heappush(ahead, (e, m))
                    heapq.heappush(best, (-e, -m))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def chosen(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """The nearest, those first that lie in directions of their own: nearer to the node than to any chosen one."""
        kept, rest = [], []
        for d, n in near:
            if len(kept) < most and (not kept or (1 - self.x[kept] @ self.x[n]).min() > d):
                kept.append(n)
            else:
                rest.append(n)
        return (kept + rest)[:most]

    def add(self, n: int, m: int, ef: int) -> None:
        u = (zlib.crc32(str(self.ids[n]).encode()) + 1) / 2**32
        top = int(-math.log(u) / math.log(m))
        self.links[n] = [[] for _ in range(top + 1)]
        if self.entry is None:
            self.entry = n
            return
        q, high = self.x[n], len(self.links[self.entry]) - 1
        near = [(float(1 - self.x[self.entry] @ q), self.entry)]
        for layer in range(high, -1, -1):
            near = self.beam(q, near, ef if layer <= top else 1, layer)
            if layer <= top:
                own = self.links[n][layer] = self.chosen(near, m)
                most = 2 * m if layer == 0 else m
                for other in own:
                    links = self.links[other][layer]
                    links.append(n)
                    if len(links) > most:
                        apart = 1 - self.x[links] @ self.x[other]
                        self.links[other][layer] = self.chosen(sorted(zip(apart.tolist(), links)), most)
        if top > high:
            self.entry = n

    def walk(self, apart: list[float], begin: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """As `beam`, where the distances of a query to the nodes are known."""
        seen, ahead, links = set(begin), [(apart[n], n) for n in begin], self.links
        best = [(-d, -n) for d, n in ahead]
        heapq.heapify(ahead)
        heapq.heapify(best)
        room = width - len(best)
        while ahead:
            d, n = heapq.heappop(ahead)
            if room <= 0 and d > -best[0][0]:
                break
            for m in links[n][layer]:
                if m in seen:
                    continue
                seen.add(m)
                e = apart[m]
                if room > 0:
                    room -= 1
                    heapq.heappush(best, (-e, -m))
                    heapq.heappush(ahead, (e, m))
                elif e <= -best[0][0] and (-e, -m) > best[0]:
                    heapq.heapreplace(best, (-e, -m))
                    heapq.heappush(ahead, (e, m))
        return sorted((-d, -n) for d, n in best)

    def search(self, embeddings: Iterable, k: int, ef: int) -> Iterator[list[tuple[float, object]]]:
        """The k nearest of each query, as (distance, id); distances of many queries are one product."""
        q = _unit(np.stack([np.asarray(e, np.float64) for e in embeddings]))
        top = len(self.links[self.entry]) - 1
        for i in range(0, len(q), QUERIES):
            for apart in (1 - q[i : i + QUERIES] @ self.x.T).tolist():
                near = [self.entry]
                for layer in range(top, -1, -1):
                    found = self.walk(apart, near, max(ef, k) if layer == 0 else 1, layer)
                    near = [n for _, n in found]
                yield sorted((d, self.ids[n]) for d, n in found)[:k]


def _kept(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where((F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)) & F.col(key).isNotNull())
    return good.select(*group, F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _own(rows: DataFrame) -> DataFrame:
    """rows with columns of their own, so that a frame and what comes of it can meet."""
    return rows.select(*[F.col(f"`{c}`").alias(c) for c in rows.columns])


def _tasks(rows: DataFrame, shards: int, *keys: str) -> DataFrame:
    """rows dealt by keys to about a task for each shard: shards are few bytes and much work, and would be merged by bytes."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, min(2 * shards, MOST_TASKS)), *keys)


def _schema(kinds: dict[str, str], group: list[str]) -> str:
    return ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "shard int", f"id {kinds['id']}", "embedding array<double>", f"links array<array<{kinds['id']}>>"])


def _named(frame: pd.DataFrame, like: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """frame with the columns of a group, the same in all rows of like."""
    return frame.assign(**{c: pd.Series([like[c].iat[0]] * len(frame), frame.index, object) for c in columns})


def build(facts: DataFrame, *, group: tuple[str, ...] = ("project_id", "fact_kind"), key: str = "fact_id", shard: int = SHARD, m: int = M, ef: int = EF) -> DataFrame:
    """group, shard, id, embedding, links: the index of facts, each of them in it."""
    by = list(group)
    rows = _kept(facts, by, key)
    sizes = durable(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("_shards")))
    shards = sizes.agg(F.sum("_shards")).first()[0] or 0
    dealt = rows.join(sizes, by).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("_shards")).cast("int")).drop("_shards")
    return _grown(_tasks(dealt.select(*by, "shard", "id", "embedding"), shards, *by, "shard"), None, by, m, ef)


def _grown(new: DataFrame, old: DataFrame | None, by: list[str], m: int, ef: int) -> DataFrame:
    """Shards with new nodes (group, shard, id, embedding) put into what they hold, old."""
    schema, keys = _schema(dict(new.dtypes), by), [*by, "shard"]
    new, old = _own(new), None if old is None else _own(old)

    def grow(a: pd.DataFrame, b: pd.DataFrame | None = None) -> pd.DataFrame:
        a = a.sort_values("id")
        held = 0 if b is None else len(b)
        graph = Layers([*([] if b is None else b["id"]), *a["id"]], [*([] if b is None else b["embedding"]), *a["embedding"]])
        if held:
            before = Layers.of_rows(b)
            graph.links[:held], graph.entry = before.links, before.entry
        for n in range(held, len(graph.ids)):
            graph.add(n, m, ef)
        vectors = [*([] if b is None else b["embedding"]), *a["embedding"]]
        return _named(graph.rows().assign(embedding=vectors), a, keys)[[*keys, "id", "embedding", "links"]]

    if old is None:
        return new.groupBy(*keys).applyInPandas(lambda a: grow(a), schema)
    return new.groupBy(*keys).cogroup(old.groupBy(*keys)).applyInPandas(lambda a, b: grow(a, b), schema)


def insert(index: DataFrame, facts: DataFrame, *, group: tuple[str, ...] = ("project_id", "fact_kind"), key: str = "fact_id", shard: int = SHARD, m: int = M, ef: int = EF) -> tuple[DataFrame, DataFrame]:
    """(the shards that change, with the facts that the index lacks; the keys (group, shard) of those that they replace)."""
    by = list(group)
    new = _kept(facts, by, key).dropDuplicates([*by, "id"]).join(index.select(*by, "id"), [*by, "id"], "left_anti")
    sizes = index.groupBy(*by, "shard").agg(F.count(F.lit(1)).alias("n"))
    room = sizes.groupBy(*by).agg(F.min(F.struct("n", "shard")).alias("least"), F.max("shard").alias("last"))
    many = new.groupBy(*by).agg(F.count(F.lit(1)).alias("more")).join(room, by, "left")
    fits = F.coalesce(F.col("least.n") + F.col("more") <= shard, F.lit(False))
    fresh = F.coalesce(F.col("last") + 1, F.lit(0)) + F.pmod(F.xxhash64("id"), F.ceil(F.col("more") / shard))
    dealt = durable(new.join(many, by).select(*by, F.when(fits, F.col("least.shard")).otherwise(fresh).cast("int").alias("shard"), "id", "embedding"))
    touched = dealt.select(*by, "shard").distinct()
    return _grown(dealt, index.join(touched, [*by, "shard"], "left_semi"), by, m, ef), touched


def search(index: DataFrame, queries: DataFrame, *, k: int = 10, most: float | None = None, group: tuple[str, ...] = ("project_id", "fact_kind"), key: str = "fact_id", ef: int = EF) -> DataFrame:
    """group, fact, other, distance, rank: about the k nearest others of each query, and of those the ones not over `most`."""
    by, kinds = list(group), dict(index.dtypes)
    keys = [*by, "_together"]
    # Neighbouring shards are searched in one task, so that it gets a query once and gives its nearest of them all.
    sizes = index.groupBy(*by, "shard").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.greatest(F.lit(1), F.floor(TOGETHER / F.max("n"))).cast("int").alias("_per"), F.max("shard").alias("_last"))
    sizes = durable(sizes)
    several = sizes.select(*by, "_per", F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / F.col("_per")).cast("int"))).alias("_together"))
    asked = _kept(queries, by, key).join(several.drop("_per"), by)
    held = _own(index).join(_own(sizes.drop("_last")), by).withColumn("_together", F.floor(F.col("shard") / F.col("_per")).cast("int")).drop("_per")

    def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts: list[pd.DataFrame] = []
        for _, rows in b.groupby("shard") if len(a) else ():
            graph = Layers.of_rows(rows)
            fit = a[a["embedding"].map(len) == graph.x.shape[1]]
            if len(fit):
                out = [(i, o, d) for i, near in zip(fit["id"], graph.search(fit["embedding"], k + 1, ef)) for d, o in near if o != i]
                parts.append(pd.DataFrame(out, columns=["fact", "other", "distance"]))
        found = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["fact", "other", "distance"])
        if len(found):
            found = found.sort_values(["fact", "distance", "other"])
            found = found[found.groupby("fact").cumcount() < k]
        return _named(found, b, by) if len(found) else pd.DataFrame({c: pd.Series([], dtype=object) for c in [*by, "fact", "other", "distance"]})

    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in by), f"fact {kinds['id']}, other {kinds['id']}, distance double"])
    n = several.count()
    met = _tasks(_own(asked), n, *keys).groupBy(*keys).cogroup(_tasks(held, n, *keys).groupBy(*keys)).applyInPandas(lambda a, b: look(a, b)[[*by, "fact", "other", "distance"]], schema)
    rank = F.row_number().over(W.partitionBy(*by, "fact").orderBy("distance", "other"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k)
    return best if most is None else best.where(F.col("distance") <= most)
