"""Pairs that meet in time, and pairs counted without being made, against all pairs of a block; running totals."""

import random

from pyspark.sql import functions as F

from factloom.operators import candidates, precheck
from factloom.operators.running import running
from factloom.schemas import VALUE

FACT = f"fact_id int, project_id string, fact_kind string, entity string, attribute string, value {VALUE}, period struct<raw_label:string>, qualifiers map<string,string>, entity_resolved boolean"
LABELS = ("FY24", "FY 2023-24", "Q1 FY24", "Q2 FY24", "H1 FY2024", "CY2023", "2023-05-01", "2023-05-02", "2019-20", "the period", "that period", None, "")
UNITS = ("INR Crore", "INR million", "USD mn", "%", "widgets", "units", "kg", None)


def facts(spark, n, seed):
    r = random.Random(seed)

    def one(i):
        kind = r.choice(("quantitative",) * 6 + ("status", "qualitative"))
        value = (r.choice(("eq", "gt", "gte", "lt", "lte", "approx", "range", None)), r.choice((None, 0.0, 1.0, 5.0, 6.5, 100.0, 127.0)), r.choice((None, 6.5, 130.0)), r.choice(UNITS), r.choice(("listed", "sold", "")), "t")
        stated = {k: r.choice(v) for k, v in {"basis": ("consol", "standalone"), "audited": ("yes", "no")}.items() if r.random() < 0.5}
        return (i, r.choice("pq"), kind, r.choice(("Acme", "acme ")), "Revenue", value, (r.choice(LABELS),), stated, r.random() < 0.7)

    return spark.createDataFrame([one(i) for i in range(n)], FACT)


def compared(spark, df):
    every = precheck.pairs_in_blocks(df)
    rows = [tuple(r) for r in every.select("project_id", "fact_id_a", "fact_id_b", "outcome", "reason").collect()]
    want = {}
    for p, _, _, outcome, reason in rows:
        want[p, outcome, reason] = want.get((p, outcome, reason), 0) + 1
    assert {tuple(r)[:3]: r["n"] for r in precheck.outcome_counts(df).select("project_id", "outcome", "reason", "n").collect()} == want
    got = [tuple(r) for r in precheck.open_pairs(df).select("project_id", "fact_id_a", "fact_id_b", "outcome", "reason").collect()]
    assert sorted(got) == sorted(r for r in rows if r[3] != "not_comparable")
    return want


def test_counts_and_open_pairs(spark):
    want = compared(spark, facts(spark, 160, 1))
    assert {"intervals overlap", "intervals do not overlap", "an entity was inferred, not stated", "periods do not meet", "a value is no interval"} <= {k[2] for k in want}


def test_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(precheck, "BLOCK", 16)
    compared(spark, facts(spark, 150, 2))


def test_rows_that_share_a_key_are_no_pair(spark):
    df = facts(spark, 60, 5)
    compared(spark, df.unionByName(df.where("fact_id % 4 = 0")).unionByName(facts(spark, 9, 6)))


def test_no_facts(spark):
    none = facts(spark, 1, 3).limit(0)
    assert precheck.outcome_counts(none).count() == 0 and precheck.open_pairs(none).count() == 0


def test_a_hot_block_of_dates_makes_few_rows(spark):
    """Two thousand facts of as many days: two million pairs, none of which meets in time, none of which is a row."""
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int"))
    value = F.struct(F.lit("eq").alias("comparator"), F.lit(1.0).alias("number"), F.lit(None).cast("double").alias("number_high"), F.lit("kg").alias("unit"), F.lit("").alias("state"), F.lit("").alias("text"))
    df = spark.range(2000).select(
        F.col("id").alias("fact_id"), F.lit("p").alias("project_id"), F.lit("quantitative").alias("fact_kind"), F.lit("A").alias("entity"), F.lit("b").alias("attribute"), value.alias("value"),
        F.struct(F.date_format(day, "yyyy-MM-dd").alias("raw_label")).alias("period"), F.create_map(F.lit("k"), F.lit("v")).alias("qualifiers"), F.lit(True).alias("entity_resolved"),
    )
    assert [(r["reason"], r["n"]) for r in precheck.outcome_counts(df).collect()] == [("periods do not meet", 2000 * 1999 // 2)]
    assert precheck.open_pairs(df).count() == 0


def test_running_totals(spark):
    r = random.Random(7)
    rows = [(r.choice("aaaaaab"), i, r.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, at int, n int")
    got = {(x["g"], x["at"]): x["upto"] for x in running(df, ["g"], ["at"], {"upto": "n"}).collect()}
    assert got == {(g, at): sum(n for h, b, n in rows if h == g and b <= at) for g, at, _ in rows}
    assert running(df.limit(0), ["g"], ["at"], {"upto": "n"}).count() == 0


def test_nearest_tells_groups_apart_and_leaves_bad_embeddings_out(spark, monkeypatch):
    r = random.Random(4)
    some = lambda n: [r.gauss(0, 1) for _ in range(n)]
    rows = [(p, "k", i, some(4 if i % 5 else 3)) for p in "ab" for i in range(60)]
    bad = [("a", "k", 900, [None, 1.0, 1.0, 1.0]), ("a", "k", 901, [float("nan")] * 4), ("b", "k", 902, [float("inf")] * 4), ("b", "k", 903, []), ("b", "k", 904, None)]
    df = spark.createDataFrame(rows + bad, "project_id string, fact_kind string, fact_id long, embedding array<double>")

    def cosine(a, b):
        return 1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = set()
    for p, _, i, v in rows:
        near = sorted((cosine(v, w), j) for q, _, j, w in rows if q == p and j != i and len(w) == len(v))[:6]
        want |= {(p, i, j, k) for k, (dist, j) in enumerate(near, 1) if dist <= 0.6}
    found = lambda: {tuple(x) for x in candidates.nearest(df, k=6, most=0.6).select("project_id", "fact", "other", "rank").collect()}
    assert found() == want
    monkeypatch.setattr(candidates, "BLOCK", 10)
    assert found() == want
