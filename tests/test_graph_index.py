"""The approximate index: recall against exact search, inserts without a rebuild, rows that are written and read again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import candidates, graph_index
from factloom.plans import queries
from factloom.plans.derived import vector_facts

SCHEMA = "project_id string, fact_kind string, fact_id long, embedding array<double>"


def made(n, seed=1, groups=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, 12))
    return [("ab"[i % 2], "k", i // 2, (centres[i % groups] + 0.5 * r.normal(size=12)).tolist()) for i in range(n)]


def pairs(df):
    return {(r["project_id"], r["fact"], r["other"]) for r in df.collect()}


def test_recall_and_inserts(spark, tmp_path):
    rows = made(700)
    bad = [("a", "k", 9001, None), ("a", "k", 9002, [None] * 12), ("b", "k", 9003, []), ("b", "k", 9004, [float("nan")] * 12)]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    first = df.where("fact_id < 200 OR fact_id > 9000")
    graph_index.build(first, shard=90, ef=48).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 400 and index.select("project_id", "shard").distinct().count() == 6
    near = lambda i, q: pairs(graph_index.search(i, q, k=8))
    exact = lambda f: pairs(candidates.nearest(f, k=8, most=None))
    want = exact(first)
    assert len(near(index, first) & want) >= 0.95 * len(want)

    some = first.unionByName(df.where("fact_id BETWEEN 200 AND 209"))  # few go into a shard that has room
    changed, touched = graph_index.insert(index, some, shard=90, ef=48)
    assert touched.count() == 2
    grown = index.join(touched, ["project_id", "fact_kind", "shard"], "left_anti").unionByName(changed)
    grown.write.parquet(str(tmp_path / "grown"))
    grown = spark.read.parquet(str(tmp_path / "grown"))
    assert grown.count() == 420
    more, new = graph_index.insert(grown, df, shard=90, ef=48)  # many make shards of their own
    assert new.join(grown.select("project_id", "shard").distinct(), ["project_id", "shard"], "left_semi").count() == 0
    whole = grown.unionByName(more)
    assert whole.count() == 700 and whole.select("project_id", "id").distinct().count() == 700
    want, got = exact(df), near(whole, df)
    assert len(got & want) >= 0.95 * len(want)
    ranks = graph_index.search(whole, df, k=8).groupBy("project_id", "fact").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"))
    assert ranks.where("m <> 8 OR n <> 8").count() == 0


def test_small_and_empty(spark):
    one = spark.createDataFrame([("a", "k", 1, [1.0, 0.0]), ("b", "k", 1, [1.0, 0.0]), ("b", "k", 2, [1.0, 0.0]), ("b", "k", 3, [0.0, 0.0])], SCHEMA)
    index = graph_index.build(one)
    got = {tuple(r) for r in graph_index.search(index, one, k=5).select("project_id", "fact", "other", "rank").collect()}
    assert got == {("b", 1, 2, 1), ("b", 1, 3, 2), ("b", 2, 1, 1), ("b", 2, 3, 2), ("b", 3, 1, 1), ("b", 3, 2, 2)}
    assert graph_index.build(one.limit(0)).count() == 0 and graph_index.search(index, one.limit(0)).count() == 0
    assert graph_index.search(index, one, k=5, most=0.5).count() == 2


def test_degrees_are_bounded():
    r = np.random.default_rng(2)
    graph = graph_index.Layers(range(600), r.normal(size=(600, 6)))
    for n in range(600):
        graph.add(n, 4, 20)
    assert max(len(layer) for node in graph.links for layer in node[1:]) <= 4 and max(len(node[0]) for node in graph.links) <= 8
    assert 0 < sum(len(node) > 1 for node in graph.links) < 300


@pytest.mark.parametrize("table", ["sf0.1"])
def test_query_recall(spark, table):
    d = f"/root/testdata/{table}"
    got = {(r["fact"], r["other"]) for r in queries.QUERIES["graph_candidates"](spark, d).collect()}
    want = {(r["fact"], r["other"]) for r in candidates.nearest(queries.vector_facts(spark, d), k=10, most=None, group=("project_id",), of=F.col("fact_id") % 50 == 0).collect()}
    assert len(want) == 400 and len(got & want) >= 0.9 * len(want), len(got & want)


def test_shards_are_built_apart_and_searched_together(spark, sf, monkeypatch):
    facts = vector_facts(spark, sf).withColumn("fact_kind", F.lit(0))
    size = max(2, facts.count() // 5)
    index = graph_index.build(facts, shard=size)
    # A task for each shard: merged by bytes, all of them would be built in one.
    assert index.rdd.getNumPartitions() >= 2 * index.select("shard").distinct().count()
    index = index.localCheckpoint()
    rows = lambda: sorted(map(tuple, graph_index.search(index, facts, k=4).collect()))
    together = rows()
    monkeypatch.setattr(graph_index, "TOGETHER", 1)
    assert together and together == rows()


def test_a_walk_over_known_distances_is_a_beam():
    x = np.random.default_rng(8).normal(size=(500, 6))
    graph = graph_index.Layers(range(500), x)
    for n in range(500):
        graph.add(n, 8, 32)
    for q in graph.x[:20]:
        apart = (1 - graph.x @ q).round(12)
        walked = graph.walk(apart.tolist(), [graph.entry], 16, 0)
        beam = graph.beam(q, [(float(apart[graph.entry]), graph.entry)], 16, 0)
        assert [n for _, n in walked] == [n for _, n in beam]
