"""Cases of a review: what queries gave that their SQL does not, and work that took more disk than its input allows."""

import random

import duckdb
from pyspark.sql import functions as F

from factloom.operators import evidence, postings
from factloom.plans import knowledge, queries, sql


def test_figures_of_lines_are_written_to_the_cent_as_in_sql(spark, tmp_path):
    db = duckdb.connect()
    noise = "l_extendedprice * CASE l_suppkey % 4 WHEN 0 THEN 1.013 WHEN 1 THEN 1 + 1e-11 WHEN 2 THEN -1e-6 ELSE 1 END AS l_extendedprice"
    db.sql(f"COPY (SELECT * REPLACE ({noise}) FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    for name, columns in (("half_steps", ["fact_id", "half"]), ("value_intervals", ["fact_id", "low", "high", "low_closed", "high_closed", "dimension"])):
        want = db.sql(f"SELECT {', '.join(columns)} FROM ({sql.SQL[name]})").fetchall()
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)), name


def test_known_questions_are_answered_without_postings_of_chunks(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(knowledge, "state_folder", lambda spark: str(tmp_path / "state"))
    df = knowledge.QUERIES["lexical_matches"](spark, sf)
    assert not (tmp_path / "state").exists()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan


def test_known_questions_are_answered_as_by_a_scan(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    words = "the net profit of 2024 License abc a_b aXb \u00fcber \u00e9te 100% sure x mit LICENSE".split()
    said = [(f"d{i // 4}", i % 3, None if i % 29 == 7 else " ".join(r.choice(words) for _ in range(r.randrange(14)))) for i in range(200)]  # some chunks have one id
    asked = [(k % 9, q) for k, q in enumerate(["License", "mit license", "a_c", "%net profit%", "net%2024", "ab", "", " x ", "\u00c9TE", r"100\% sure", r"a\_b", "nowhere at all", "fit%the", "License", None])]  # some questions too
    chunks, questions = spark.createDataFrame(said, "document_id string, chunk_index int, text string"), spark.createDataFrame(asked, "question_id int, query string")
    want = sorted((k, d, i) for k, q in asked if q is not None for d, i in map(tuple, chunks.where(F.ilike("text", F.lit(f"%{q.strip()}%"))).select("document_id", "chunk_index").collect()))
    assert sorted(map(tuple, postings.answers(chunks, questions, str(tmp_path / "a")).collect())) == want
    assert not (tmp_path / "a").exists()
    one = questions.where("query IN ('mit license', 'net%2024', 'ab')")
    less = sorted(map(tuple, postings.answers(chunks, one, str(tmp_path / "b")).distinct().collect()))
    monkeypatch.setattr(postings, "MOST_ASKED", 3)
    assert less and less == sorted(map(tuple, postings.answers(chunks, one, str(tmp_path / "c")).distinct().collect())) and (tmp_path / "c").exists()


def test_texts_of_boxes_move_once_and_words_do_not(spark, sf):
    plan = knowledge.QUERIES["evidence_boxes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # Two of one kind, the second of which is the first read again: texts by page.
    assert plan.count("Exchange hashpartitioning(document_id") == plan.count("Exchange") == plan.count("partial_collect_list(text") == 2
    assert "Sort " not in plan and "Window" not in plan


def test_boxes_of_odd_words(spark):
    said = ["one", " ", "Two\u00a0", "three  more", "", "fo\u0001ur", "F\u00cfVE", None, "two", "three"]
    words = spark.createDataFrame([("d", 1, i, i // 3, w, 10.0 * i, 20.0 * (i // 3), 10.0 * i + 5, 20.0 * (i // 3) + 12) for i, w in enumerate(said)], "document_id string, page_number int, place int, line int, word string, x0 double, y0 double, x1 double, y1 double")
    at = lambda i, j: (10.0 * i, 20.0 * (i // 3), 10.0 * j + 5, 20.0 * (j // 3) + 12)
    want = {"one two": [at(0, 2)], "TWO THREE": [at(2, 2), at(3, 3), at(8, 8), at(9, 9)], "more fo": [at(3, 5)], "f\u00efve": [at(6, 6)], "hree": [at(3, 3), at(9, 9)], "nowhere": None}
    facts = spark.createDataFrame([(k, "d", 1, k, "") for k in want], "fact_id string, document_id string, page_number int, matched_text string, evidence_text string")
    pages = words.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("place", "line", "word", "x0", "y0", "x1", "y1"))).alias("words"))
    for given in (words, pages):
        got = {r["fact_id"]: [tuple(b) for b in r["boxes"]] for r in evidence.boxes(facts, given).collect()}
        assert got == {k: v for k, v in want.items() if v}
