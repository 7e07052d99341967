"""Centroid clustering: against plain rounds in Python integers; bounds; odd rows."""

import hashlib

import numpy as np
import pytest

from factloom.llm import clusters
from factloom.llm.queries import op13_clusters


def brute(rows, k=8, rounds=10, seed=3):
    """(vec_id, cluster, distance) of each row and the centroids, by full scans."""
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows)[:k]
    centres = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        of = {}
        for _, v in rows:
            of.setdefault(nearest(v)[1], []).append(v)
        for j, vs in of.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted((i, j, min(d, 2**63 - 1)) for i, v in rows for d, j in [nearest(v)]), centres


def run(spark, rows, **given):
    placed, centres = clusters.cluster(spark.createDataFrame(rows, "vec_id long, v array<long>"), **given)
    return sorted(map(tuple, placed.collect())), centres


def made(n, dims, spread, seed, groups=12):
    r = np.random.default_rng(seed)
    centres = r.integers(-1000, 1000, (groups, dims))
    return [(i, (centres[i % groups] + r.integers(-spread, spread + 1, dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("bounds,bucket,spread", [(3, None, 300), (1, 50, 900), (7, 2000, 5)])
def test_equals_full_scans(spark, bounds, bucket, spread):
    rows = made(400, 6, spread, bounds)
    assert run(spark, rows, bounds=bounds, bucket=bucket) == brute(rows)


def test_ties_repeats_and_few_vectors(spark):
    grid = [(i, [i % 4, i // 4 % 4]) for i in range(64)] + [(7, [3, 1])] * 5  # many equal distances, repeated rows
    assert run(spark, grid, k=5) == brute(grid, k=5)
    same = [(i, [1, 2, 3]) for i in range(30)]  # eight centroids in one place, seven of them empty
    assert run(spark, same) == brute(same)
    few = [(1, [5, 5]), (2, [0, 9])]
    assert run(spark, few, k=8) == brute(few, k=8)
    assert run(spark, [(1, [4])], k=8) == ([(1, 0, 0)], [[4]])
    assert run(spark, few, k=2, rounds=0) == brute(few, k=2, rounds=0)
    assert run(spark, [], k=2) == ([], [])


def test_large_numbers(spark):
    far = [(i, [(-1) ** i * 2**52 + i * 10**12, i * 3**20]) for i in range(40)]
    assert run(spark, far, k=4, rounds=3) == brute(far, k=4, rounds=3)


def test_whole_vectors(spark):
    f = float
    rows = [(1, [0.5, -0.0001]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [f("nan"), 1.0]), (6, [f("inf"), 1.0]), (7, []), (None, [1.0, 1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS row")
    kept = {r["vec_id"]: r["v"] for r in clusters.whole_vectors(df, length=2).collect()}
    assert kept == {1: [512, -1], None: [1024, clusters.FAR]}


def test_bounds_skip_scans_and_never_lie():
    """Over many rounds of small moves few vectors are scanned again, and each bound holds."""
    r = np.random.default_rng(5)
    centres = r.integers(-1000, 1000, (20, 8))
    x = centres[r.integers(0, 20, 3000)] + r.integers(-80, 80, (3000, 8))
    s, scans = clusters.Bounds.fresh(x, centres, 4), 0
    for round_ in range(8):
        now = centres + r.integers(-6, 7, centres.shape)
        moves = np.sqrt(((now - centres) ** 2).sum(axis=1).astype(float)) * (1 + clusters.LOOSE)
        centres = now
        if round_ == 4:
            s.narrowed(2)
        s.assign(x, centres, moves)
        d = ((x[:, None, :] - centres) ** 2).sum(axis=2)
        assert (s.own == d.argmin(axis=1)).all()
        true = np.sqrt(d.astype(float))
        rows = np.arange(len(x))
        assert (s.high >= true[rows, s.own]).all()
        assert (s.low <= true[rows[:, None], s.near]).all()
        others = np.ones_like(d, bool)
        others[rows, s.own] = False
        others[rows[:, None], s.near] = False
        assert (s.rest <= np.where(others, true, np.inf).min(axis=1)).all()
        scans += int((s.used == s.near.shape[1] + 1).sum())
    assert scans < 0.05 * 8 * len(x)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["v"]) for r in clusters.whole_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()]
    want, centres = brute(rows)
    got = op13_clusters(spark, sf).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clusters_")]
