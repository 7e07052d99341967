"""Exact top-k search against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import knn
from factloom.llm.common import table
from factloom.llm.queries import op2_knn


def brute(rows, k=10):
    good = [(i, [math.floor(float(c) * 1024) for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    out = set()
    for q, e in good:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q and len(f) == len(e))[:k]
            out |= {(q, r, i, -v) for r, (v, i) in enumerate(s, 1)}
    return out


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    assert {tuple(r) for r in op2_knn(spark, sf).collect()} == brute(rows)


def test_edges_and_small_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # one hot vector
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0]), (2002, [float("nan")] * 4), (2100, [float("inf")] * 4), (2101, []), (2102, [1.0])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    out = knn.top_k(knn.whole_vectors(df), F.col("vec_id") % 100 == 0, n_pivots=8, block_rows=50, block_queries=2)
    assert {tuple(r) for r in out.collect()} == brute(rows)
    assert knn.top_k(knn.whole_vectors(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0
    few = knn.top_k(knn.whole_vectors(df.where("vec_id < 4")), F.col("vec_id") % 100 == 0)
    assert few.count() == 3


def test_huge_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [1e12, 3.0]), (1, [2.0, 1e-3]), (2, [2.0, 2e-3]), (3, [2.0, 1e-3])], "vec_id long, embedding array<double>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert {tuple(r) for r in knn.top_k(knn.whole_vectors(df), F.col("vec_id") == 0).collect()} == brute(rows)


def test_far_cells_are_not_asked(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in (np.eye(3)[i % 3] * 5 + rng.normal(size=3) * 0.01)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in knn.top_k(knn.whole_vectors(df), F.col("vec_id") % 100 == 0, n_pivots=6).collect()} == brute(rows)


def test_repeated_query_ids_stay_exact(spark):
    rng = np.random.default_rng(3)
    far = [(i, [float(c) for c in rng.normal(size=2)]) for i in range(1, 41)]
    rows = [(100, [10.0, 0.0])] * 15 + far  # the query's rows fill a cell of their own
    schema = "vec_id long, embedding array<double>"
    out = {tuple(r) for r in knn.top_k(knn.whole_vectors(spark.createDataFrame(rows, schema)), F.col("vec_id") == 100, n_pivots=100).collect()}
    assert out == brute([(100, [10.0, 0.0])] + far) and len(out) == 10
    # rows of the same vec_id that are no queries don't count as others either
    rows = [(100, [10.0, 0.0])] + [(100, [9.5, 0.0])] * 15 + far
    out = {tuple(r) for r in knn.top_k(knn.whole_vectors(spark.createDataFrame(rows, schema)), F.element_at("v", 1) == 10 * 1024, n_pivots=100).collect()}
    assert out == brute([(100, [10.0, 0.0])] + far)


def test_repeated_query_ids_with_any_number_of_pivots(spark):
    rng = np.random.default_rng(4)
    others = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(1, 16)]
    df = spark.createDataFrame([(0, [3.0, 0.0, 0.0])] * 30 + others, "vec_id long, embedding array<double>")
    want = brute([(0, [3.0, 0.0, 0.0])] + others)
    for n in (1, 2, 4, 32, 64):
        assert {tuple(r) for r in knn.top_k(knn.whole_vectors(df), F.col("vec_id") == 0, n_pivots=n, block_rows=7).collect()} == want


def test_only_what_is_needed_is_copied(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in (np.eye(8)[i % 8] * 5 + rng.normal(size=8) * 0.02)]) for i in range(1600)]
    vectors = knn.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    one = (F.col("vec_id") % 8 == 0) & (F.col("vec_id") % 100 == 0)  # queries of one cluster
    routed = knn.route(vectors, one, n_pivots=64)
    blocks = knn.blocks_of(routed, 50)
    asked = {r["cell"] for r in routed.asks.collect()}
    of_cell = {r["vec_id"]: r["cell"] for r in routed.placed.collect()}
    moved = [r["vec_id"] for r in knn.copied(routed, blocks).collect()]
    assert moved and len(moved) < 250 and {of_cell[i] for i in moved} <= asked  # a cell that is not asked moves no row
    assert {i % 8 for i in moved} == {0}
    # the salted join copies the same
    most, salted = knn.MOST_BROADCAST, knn.SALTED
    try:
        knn.MOST_BROADCAST, knn.SALTED = 0, 7
        assert sorted(r["vec_id"] for r in knn.copied(routed, blocks).collect()) == sorted(moved)
    finally:
        knn.MOST_BROADCAST, knn.SALTED = most, salted


def test_many_groups_of_queries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(700)] + [(7_000 + 100 * i, [1.0] * 6) for i in range(60)]  # a hot cell of queries
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, cell string, row int")
    out = knn.top_k(knn.whole_vectors(df), F.col("vec_id") % 100 == 0, n_pivots=20, block_rows=100, block_queries=5)
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(7)
    rows = [(100 * i if i % 4 == 0 else i, [float(c) for c in rng.normal(size=2 + i % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in knn.top_k(knn.whole_vectors(df), F.col("vec_id") % 100 == 0, n_pivots=5).collect()} == brute(rows)
    both = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0]), (1, [1.0, 1.0]), (2, [2.0]), (3, [3.0])], "vec_id long, embedding array<double>")
    out = knn.top_k(knn.whole_vectors(both), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["rank"]) for r in sorted(out, key=lambda r: r["rank"])] == [(3, 1), (2, 2)]  # its smallest vector is the short one


def test_groups_are_merged_where_bounds_leave_out_little(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    rows = [(i, [float(c) for c in v / np.linalg.norm(v)]) for i, v in enumerate(x)]
    vectors = knn.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    routed = knn.route(vectors, F.col("vec_id") % 5 == 0, n_pivots=8, block_queries=8)
    needed = lambda r: knn.blocks_of(r, 100).agg(F.sum("n")).first()[0]
    one = knn.merged(routed, 1)
    assert needed(routed) > 5 * needed(one) and needed(one) <= 600
    assert one.queries.select("grp", "part").distinct().count() == 1 and one.queries.count() == 120
