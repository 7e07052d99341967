"""Hard negatives: against brute force on clustered, tied, repeated and odd rows; rounds; bounded gathering."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import negatives

SCHEMA = "vec_id long, label long, v array<double>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, negatives_=5, percent=80):
    out = []
    anchors = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if is_anchor(i):
            anchors.setdefault(i, (label, v))
    for a, (label, v) in anchors.items():
        scored = sorted((-int(sum(int(p) * int(q) for p, q in zip(v, w))), i, m) for i, m, w in rows if i != a and len(w) == len(v))
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            near = [(t, n) for t, n, m in scored if m != label and percent * -s <= 100 * -t <= 100 * -s][:negatives_]
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, every=5, **given):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, **given).select(*COLUMNS).collect()))


def made(n, labels, seed, spread=0.3, dims=8, scale=256):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, dims))
    own = r.integers(0, labels, n)
    x = np.floor((centres[own] + spread * r.normal(size=(n, dims))) * scale)
    return [(i, int((own[i] + (i % 3 == 0)) % labels), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("block,group", [(32_768, 16_384), (37, 7)])
def test_equals_brute_force(spark, block, group):
    rows = made(300, 4, 1)
    got = mined(spark, rows, block=block, group=group)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) > 300


def test_ties_repeats_lengths_and_signs(spark):
    same = [(i, i % 2, [3.0, 4.0]) for i in range(200)]  # one score for all
    mixed = [(300, 0, [1.0, 0.0]), (305, 0, [1.0, 0.0]), (305, 1, [1.0, 0.0]), (310, 1, [-5.0, 1.0]), (311, 0, [0.0, 0.0])]
    others = [(400, 0, [1.0, 2.0, 3.0]), (401, 0, [1.0, 2.0, 3.0]), (402, 1, [1.0, 2.0, 2.0]), (405, 1, [9.0]), (410, 2, [7.0])]
    again = [(500, 0, [2.0, 2.0])] * 3 + [(501, 1, [2.0, 2.0])] * 3
    rows = same + mixed + others + again
    assert mined(spark, rows, block=50, group=10) == brute(rows, lambda i: i % 5 == 0)


def test_large_numbers(spark):
    rows = [(i, i % 2, [float(10**8 + i), float(-3 * 10**8 + 7 * i)]) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    huge = mined(spark, [(i, i % 2, [1e30, 1e30]) for i in range(6)])
    assert {r[4] for r in huge} == {negatives.LIMIT}


def test_null_and_empty_rows(spark):
    f = float
    rows = [(0, 1, [1.0, 1.0]), (1, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (2, 1, None), (3, 1, [None, 1.0]), (4, 1, [f("nan"), 1.0]), (5, 2, [f("inf"), 1.0]), (6, 2, []), (7, 1, [0.5, -0.1])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    kept = negatives.whole_vectors(df)
    assert sorted(map(tuple, ((r[0], r[1], tuple(r[2])) for r in kept.collect()))) == [(0, 1, (256.0, 256.0)), (7, 1, (128.0, -26.0))]
    assert negatives.mine(kept.limit(0), F.lit(True)).count() == 0
    assert negatives.mine(kept, F.lit(True)).count() == 0  # no other label


def test_histograms_end_where_the_need_is_met():
    asks = pd.DataFrame({"anchor_id": [9], "label": [0], "v": [[1.0]], "same": [True], "slots": [[0]], "lows": [[0]], "tops": [[1023]], "needs": [[3]], "shifts": [[2]]})
    rows = pd.DataFrame({"vec_id": range(8), "label": [0] * 7 + [1], "v": [[1000.0], [1001.0], [900.0], [899.0], [500.0], [2000.0], [-1.0], [1023.0]]})
    got = negatives.count(asks, rows)
    assert got.values.tolist() == [[9, 0, 5, 2], [9, 0, 30, 1]]  # 1000 and 1001, then 900; 899 in a lower bucket is not told
    few = negatives.gather(asks, rows, 2)
    assert few.values.tolist() == [[9, 0, 1, 1001], [9, 0, 0, 1000]]
