"""Profiles as a stream: any split into batches, restarts and repeated documents give what one fold gives."""

import random

from pyspark.sql import functions as F

from factloom.operators import clusters
from factloom.plans import queries
from factloom.streaming import profiles

SCHEMA = "project_id string, document_id long, created_at long, doc_embedding array<double>"


def made(n, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    return [(r.choice("ab"), i, i // 3, [x + r.gauss(0, 0.3) for x in r.choice(centres)]) for i in range(n)]


def streamed(spark, folder):
    return profiles.placements(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")), join=0.8)


def rows(df):
    return sorted((r["project_id"], r["document_id"], r["sub_cluster_id"], round(r["similarity"], 9), r["off_domain"]) for r in df.collect())


def test_any_split_and_a_restart(spark, tmp_path):
    docs = made(60)
    want = rows(clusters.assign(spark.createDataFrame(docs, SCHEMA), join=0.8))
    whole = {r["project_id"]: r for r in clusters.profiles(spark.createDataFrame(docs, SCHEMA), join=0.8).collect()}
    bad = [(None, 900, 0, [1.0] * 5), ("a", 901, 0, None), ("a", 902, 0, [None, 1.0, 1.0, 1.0, 1.0]), ("b", 903, 0, [])]
    for name, cuts in (("one", [60]), ("three", [9, 33, 60]), ("many", [3, 6, 30, 57, 60])):
        at, begin = tmp_path / name, 0
        for cut in cuts:
            again = docs[max(0, begin - 4) : begin]  # documents that came before come again
            spark.createDataFrame(docs[begin:cut] + again + bad, SCHEMA).coalesce(1).write.mode("append").parquet(str(at / "in"))
            profiles.run(streamed(spark, at), str(at / "out"), str(at / "state"))  # each time a new start
            begin = cut
        profiles.run(streamed(spark, at), str(at / "out"), str(at / "state"))  # nothing has arrived
        placed = spark.read.parquet(str(at / "out"))
        assert rows(placed) == want
        got = {r["project_id"]: r for r in profiles.latest(placed).collect()}
        assert set(got) == set(whole)
        for p, r in got.items():
            assert r["document_count"] == whole[p]["document_count"] and r["sizes"] == [c["size"] for c in whole[p]["clusters"]]
            assert max(abs(a - b) for a, b in zip(r["centre"], whole[p]["centre"])) < 1e-9
            for mine, c in zip(r["centres"], whole[p]["clusters"]):
                assert max(abs(a - b) for a, b in zip(mine, c["centre"])) < 1e-9


def test_terms_are_new_once(spark, tmp_path):
    schema = "project_id string, document_id long, entity string"
    for rows_ in ([("a", 1, " Acme "), ("a", 1, "Acme"), ("b", 2, "Acme"), ("a", 3, " "), ("a", 3, None)], [("a", 4, "Acme"), ("a", 4, "Zed")]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        profiles.run(profiles.new_terms(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["project_id"], r["term"], r["document_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "Acme", 1), ("a", "Zed", 4), ("b", "Acme", 2)]


def test_query_equals_the_fold(spark, sf):
    got = {(r["project_id"], r["document_id"]): (r["sub_cluster_id"], r["off_domain"]) for r in queries.QUERIES["streamed_profiles"](spark, sf).collect()}
    docs = queries.vector_facts(spark, sf).select(F.col("fact_kind").alias("project_id"), F.col("fact_id").alias("document_id"), F.col("fact_id").alias("created_at"), F.col("embedding").alias("doc_embedding"))
    want = {(r["project_id"], r["document_id"]): (r["sub_cluster_id"], r["off_domain"]) for r in clusters.assign(docs, join=0.3).collect()}
    assert got == want and got
