"""Cases of a review: what queries and operators gave that their SQL does not, and work that grew faster than its input."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.functions import repair, text
from factloom.operators import candidates, chunking, compare, extraction, grounding, postings, precheck, routing, table_finder
from factloom.plans import derived, knowledge, queries, sql
from factloom.sources.shared import durable


def test_shares_of_pages_are_rounded_from_the_product(spark):
    kinds = ["table_heavy"] * 29 + ["image_only"] * 2 + ["text_native"] * 169
    rows = [("d", k, 600.0, 800.0, 500, 0.0) for k in kinds]
    pages = spark.createDataFrame(rows, "document_id string, content_type string, width double, height double, char_count int, image_area_ratio double")
    for c in ("producer", "creator"):
        pages = pages.selectExpr("*", f"cast(null as string) AS {c}")
    # 100 * 29 / 200 is 14.5; 100 * (29 / 200) is a little less.
    assert routing.profile(pages).first()["signals"] == ["prose with 15% table pages and 0% image-rich pages"]


def test_pages_of_one_character_are_anchored_as_in_sql(spark, tmp_path):
    texts = "\n".join(["a", "b", "c", "d", "ab", "abc", "one two three four", " "])
    spark.createDataFrame([(0, texts, "en", "web", len(texts))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["document_id", "page", "anchor_start", "anchor_end", "exact"]
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({knowledge.SQL['anchor_quotes']})").fetchall()
    assert sorted(tuple(r) for r in knowledge.QUERIES["anchor_quotes"](spark, str(tmp_path)).select(*columns).collect()) == sorted(want)
    assert len(want) == 7


def test_each_clause_is_cut_once(spark, capsys):
    value = F.struct(F.lit("eq").alias("comparator"), F.col("id").cast("double").alias("number"))
    facts = spark.range(5).select(F.lit("quantitative").alias("fact_kind"), value.alias("value"), F.concat(F.lit("more than "), "id", F.lit(" units")).alias("evidence_text"))
    repair.repair_comparators(facts).groupBy("value.comparator").count().explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_instr") <= 2 and plan.count("Range (") == 1


def test_facts_of_small_blocks_move_once(spark, sf, monkeypatch, capsys):
    facts = derived.line_facts(spark, sf)
    few = facts.where("entity IN ('Supplier 1', 'Supplier 2', 'Supplier 5')").unionByName(facts.where("entity = 'Supplier 1'").withColumn("period", F.struct(F.lit("some day").alias("raw_label"))).limit(40))
    few = durable(few)
    found = precheck.open_pairs(few)
    found.explain()
    plan = capsys.readouterr().out
    # Each fact is a row of one shuffle; no dictionary moves facts, and no slot copies them.
    assert plan.count("SortMergeJoin") == 1 and "Generate explode" not in plan
    pairs, counts = sorted(map(str, found.collect())), sorted(map(str, precheck.outcome_counts(few).collect()))
    monkeypatch.setattr(precheck, "SMALL", 3)
    assert pairs and pairs == sorted(map(str, precheck.open_pairs(few).collect()))
    assert counts and counts == sorted(map(str, precheck.outcome_counts(few).collect()))


def test_trigrams_of_a_long_text_take_one_pass(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ABCdef \nß😀") for _ in range(200_000))
    begun = time.monotonic()
    found = spark.createDataFrame([(text,), ("ab",), (None,)], "t string").repartition(1).select(postings.trigrams(F.col("t")).alias("g")).collect()
    low = text.lower()
    assert sorted(map(sorted, (r["g"] for r in found))) == sorted([[], [], sorted({low[i : i + 3] for i in range(len(low) - 2)})])
    assert time.monotonic() - begun < 20


def test_groups_that_cells_do_not_cut_are_cut_by_hash(spark, monkeypatch):
    rng = random.Random(2)
    vectors = [[round(rng.gauss(0, 1) * 1024) / 1024 for _ in range(8)] for _ in range(300)]  # floats, whose products are exact
    rows = [("p", "k", i, vectors[i % 300 if i < 360 else 7]) for i in range(400)]  # 60 copies of others, 40 more of one
    df = spark.createDataFrame(rows, "project_id string, fact_kind string, fact_id long, embedding array<double>")
    db = duckdb.connect()
    db.execute("CREATE TABLE t (id BIGINT, e DOUBLE[])")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(i, e) for _, _, i, e in rows])
    near = "SELECT a.id AS f, b.id AS o, list_cosine_distance(a.e, b.e) AS d FROM t a JOIN t b ON a.id <> b.id"
    want = db.sql(f"SELECT f, o, d, k FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d, o) AS k FROM ({near})) WHERE k <= 6 AND d <= 0.5").fetchall()
    for block in (candidates.BLOCK, 100):
        monkeypatch.setattr(candidates, "BLOCK", block)
        monkeypatch.setattr(candidates, "PIVOTS", 24)
        # Distances of floats are SQL's to the last bit, so copies tie and go by their keys.
        assert sorted(map(tuple, candidates.nearest(df, k=6, most=0.5).select("fact", "other", "distance", "rank").collect())) == sorted(want)
    named = df.select("project_id", "fact_kind", F.col("fact_id").alias("id"), "embedding", F.lit(True).alias("asks"), F.lit(True).alias("found"))
    assert candidates._dealt(named, ("project_id", "fact_kind"), 1.0)[0].count() == 4 * 400


def test_a_comparison_finds_its_nearest_once(spark, sf, monkeypatch, capsys):
    monkeypatch.setattr(compare, "compare_document", lambda facts, none, answers, **_: answers)
    for answers in (a := knowledge.compared(spark, sf)).verdicts, a.steps, a.final:
        answers.explain()
        assert "FlatMapCoGroups" not in capsys.readouterr().out


def test_blocks_move_without_their_facts(spark, sf, capsys):
    knowledge.QUERIES["fact_blocks"](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "first(block" in plan and "first(value" not in plan and "first(qualifiers" not in plan


def test_batches_of_many_documents_take_no_call_each(spark, capsys):
    rng = random.Random(3)
    rows = [(d, i, "x" * rng.choice((1, 3000, 9000, 12_000)), "| t |" if rng.random() < 0.2 else None) for d in range(40) for i in range(rng.randrange(1, 20))]
    want = {}
    for d, i, text, is_table in rows:
        batch, pages, chars = want[d, i - 1] if i else (-1, 0, 0)
        if is_table:
            want[d, i] = (batch + 1, 0, chars)
        elif not pages or pages >= 6 or chars + len(text) > 10_000:
            want[d, i] = (batch + 1, 1, len(text))
        else:
            want[d, i] = (batch, pages + 1, chars + len(text))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a document goes over several batches of rows
    try:
        planned = chunking.plan_batches(spark.createDataFrame(rows, "document_id long, chunk_index int, text string, table_markdown string"))
        planned.explain()
        assert "InPandas" in (plan := capsys.readouterr().out) and "FlatMapGroupsInPandas" not in plan
        assert {(r["document_id"], r["chunk_index"]): r["batch"] for r in planned.collect()} == {k: v[0] for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _lines_like(db, where, columns):
    """lineitem of the smallest tables with columns replaced, as a folder of tables."""
    db.sql(f"COPY (SELECT * REPLACE ({columns}) FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{where}/lineitem.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{where}/lineitem.parquet'")


def test_intervals_of_lines_without_a_figure_are_as_in_sql(spark, tmp_path):
    db = duckdb.connect()
    odd = "CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE l_extendedprice END AS l_extendedprice, CASE l_suppkey % 4 WHEN 0 THEN NULL ELSE l_partkey END AS l_partkey"
    _lines_like(db, tmp_path, odd)
    want = db.sql(f"SELECT fact_id, low, high, low_closed, high_closed, dimension FROM ({sql.SQL['value_intervals']})").fetchall()
    got = [tuple(r) for r in queries.QUERIES["value_intervals"](spark, str(tmp_path)).select("fact_id", "low", "high", "low_closed", "high_closed", "dimension").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_pages_move_once_and_meet_in_no_join(spark):
    words = spark.range(100).selectExpr(
        "'d' || id % 3 AS document_id", "cast(id % 5 AS int) AS page_number", "cast(id AS int) AS place", "cast(id % 7 AS int) AS line", "'w' AS word", "id * 9d AS x0", "id % 7 * 20d AS y0", "id * 9d + 5 AS x1", "id % 7 * 20d + 10 AS y1"
    )
    plan = _plan(table_finder.find_tables(words))
    assert plan.count("Exchange hash") == 1 and "Join" not in plan


def test_lines_of_orders_are_dealt_before_they_are_grouped(spark):
    # Each of the groups, which are nearly as many as the lines, is held by the one task that its order was dealt to, not by that which reads a split of a file.
    plan = _plan(knowledge.QUERIES["evidence_neighbours"](spark, "/root/testdata/sf0.001"))
    from_the_top = [x for x in plan.splitlines() if "HashAggregate" in x or "REPARTITION" in x]
    assert "HashAggregate" in from_the_top[0] and "REPARTITION" in from_the_top[-1]


def test_products_are_read_again_only_where_near_facts_can_be(monkeypatch):
    x = np.random.default_rng(5).normal(size=(6000, 64))
    x[5999] = x[17]
    facts = pa.table({"id": pa.array(range(6000)), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))})
    read, plain = [0], np.nonzero

    def counted(m):
        read[0] += m.size
        return plain(m)

    monkeypatch.setattr(candidates.np, "nonzero", counted)
    q, j, _ = candidates._nearest_of(facts.slice(0, 2000), facts, 8, 0.75)
    assert read[0] < 2000 * 6000 / 3
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    apart = 1 - u[:2000] @ u.T
    apart[np.arange(2000), np.arange(2000)] = np.inf
    assert (np.sort(apart, axis=1)[:, :8] <= 0.75).all()
    assert set(zip(q.tolist(), j.tolist())) == {(i, int(o)) for i in range(2000) for o in np.argsort(apart[i], kind="stable")[:8]}


def test_pairs_of_parts_are_not_merged_by_bytes(spark, sf, monkeypatch, capsys):
    facts = derived.vector_facts(spark, sf).withColumn("fact_kind", F.lit(0))
    want = sorted(map(tuple, candidates.nearest(facts, k=3, most=0.9).collect()))
    monkeypatch.setattr(candidates, "BLOCK", max(2, facts.count() // 3))
    found = candidates.nearest(facts, k=3, most=0.9)
    found.explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") == 2
    assert want and want == sorted(map(tuple, found.collect()))


def test_grounding_reads_rows_once_and_makes_each_form_once(spark, capsys):
    rows = spark.range(3).select(F.lit("b  C dd").alias("evidence_text"), F.concat(F.lit("x a B c "), F.lit("Dd "), "id").alias("text"))
    out = grounding.ground(rows)
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Range (") == 1 and "Union" not in plan
    forms = plan.count("translate(")
    assert forms <= 4
    assert [(r["passed"], r["matched_start"], r["matched_end"]) for r in out.collect()] == [(True, 4, 10)] * 3


def test_forms_by_word_are_those_by_character():
    rng = random.Random(3)
    for n in range(20_000):
        said = "".join(rng.choice("aB cD  \t\n-‘”—é Σσİ​  x1ß.\x1c") for _ in range(rng.randrange(14)))
        for plain, gone in ((grounding.PLAIN, None), (grounding.GROUNDED, grounding.GONE)):
            form, at = grounding._form(said, plain, gone)
            assert (form, list(at)) == grounding._form_by_character(said, plain, gone)
    assert isinstance(grounding._form("one two")[1], range)


def test_texts_are_stripped_and_collapsed_as_by_pattern(spark):
    rng = random.Random(4)
    said = [("".join(rng.choice("ab \t\n\r\x0b\x0c\x1c\x85\xa0  ​  　é") for _ in range(rng.randrange(9))),) for _ in range(5000)] + [(None,)]
    df = durable(spark.createDataFrame(said, "t string"))
    one = df.select(text.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("p"), text.collapse(F.col("t")).alias("c"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("q"))
    assert one.where("NOT (s <=> p) OR NOT (c <=> q)").count() == 0
    digits = df.select(routing.digit_ratio(F.col("t")).alias("d"), F.when(F.length("t") > 0, F.length(F.regexp_replace("t", r"\P{Nd}", "")) / F.length("t")).otherwise(0.0).alias("e"))
    assert digits.where("NOT (d <=> e)").count() == 0


def test_anchoring_reads_rows_once(spark, capsys):
    rows = spark.range(4).select(F.when(F.col("id") == 0, "b c").when(F.col("id") == 1, "B  c").when(F.col("id") == 2, "zz").alias("evidence_text"), F.lit("a b c d").alias("text"), F.lit(10).alias("char_start"), "id")
    out = grounding.anchor(rows)
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Range (") == 1 and "Union" not in plan
    assert [tuple(r) for r in out.orderBy("id").select("anchor_start", "anchor_end", "exact").collect()] == [(12, 15, True), (12, 15, False), (None, None, None), (None, None, None)]


def test_labels_of_proposed_facts_are_read_before_they_meet_their_chunks(spark, monkeypatch):
    seen, plain = [], extraction.with_period
    monkeypatch.setattr(extraction, "with_period", lambda df, label, out: seen.append(df.columns) or plain(df, label, out))
    chunks = spark.createDataFrame([(1, 0, "a b c d", 0, 1.0, None)], "document_id long, chunk_index int, text string, char_start int, confidence_ceiling double, table_markdown string")
    kept, dropped = extraction.finalise(queries.proposed_facts(chunks), chunks)
    assert seen and all("char_start" not in columns for columns in seen)
    assert kept.count() + dropped.count() == 2


def test_facts_of_boxes_are_made_from_pages_that_move_as_rows(spark, sf, monkeypatch, capsys):
    seen, plain = [], knowledge.evidence.boxes
    monkeypatch.setattr(knowledge.evidence, "boxes", lambda facts, words: seen.append(facts) or plain(facts, words))
    knowledge.QUERIES["evidence_boxes"](spark, sf)
    seen[0].explain()
    plan = capsys.readouterr().out
    # The one explosion is that of documents into pages.
    assert plan.count("Generate posexplode") == 1
