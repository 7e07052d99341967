"""Operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import candidates, chunking, clusters, concepts, grounding, precheck, provider, relationships, routing, search, tables, verification
from factloom.scope import Scope
from factloom.schemas import TABLES, VALUE

FACT = f"fact_id int, project_id string, fact_kind string, entity string, attribute string, value {VALUE}, period struct<raw_label:string>, qualifiers map<string,string>, entity_resolved boolean"


def fact(i, kind="quantitative", entity="Acme", attribute="Revenue", c="eq", n=None, unit=None, state=None, label=None, q=None, resolved=True):
    return (i, "p", kind, entity, attribute, (c, n, None, unit, state, None), (label,), q or {}, resolved)


SHIP, CR = dict(unit="shipments"), dict(n=127.0, unit="INR Crore", label="FY24")
PAIRS = [
    (dict(c="gt", n=33250.0, **SHIP), dict(n=33278.0, **SHIP), "corroborates"),
    (CR, dict(n=1266.41, unit="INR million", label="FY 2023-24"), "corroborates"),
    (CR, dict(n=1266.41, unit="INR million", label="FY 2023-24", resolved=False), "needs_adjudication"),
    (dict(n=6.5, unit="%", label="2025-26"), dict(n=6.6, unit="%", label="2025-26"), "needs_adjudication"),
    (dict(n=5.0, unit="%", q={"basis": "consolidated"}), dict(n=5.0, unit="%", q={"basis": "standalone"}), "needs_adjudication"),
    (dict(n=100.0, unit="INR Cr"), dict(n=100.0, unit="USD mn"), "needs_adjudication"),
    (dict(n=6.5, unit="%"), dict(n=6.5, unit="INR Cr"), "not_comparable"),
    (dict(n=500.0, unit="widgets"), dict(n=500.0, unit="gizmos"), "needs_adjudication"),
    (dict(n=500.0, unit="widgets"), dict(n=500.0, unit="kg"), "not_comparable"),
    (dict(n=45000.0, unit="SKUs"), dict(n=45000.0, unit="units"), "needs_adjudication"),
    (dict(n=45.0, unit="warehouses"), dict(n=45.0, unit="warehouses"), "corroborates"),
    (dict(n=1.0, unit="%", label="FY24"), dict(n=1.0, unit="%", label="FY23"), "not_comparable"),
    (dict(n=1.0, unit="%", label="Q4 FY24"), dict(n=1.0, unit="%", label="FY24"), "needs_adjudication"),
    (dict(n=1.0), dict(kind="status", state="x"), "not_comparable"),
    (dict(n=1.0, entity="X"), dict(n=1.0, entity="Y"), "not_comparable"),
    (dict(n=1.0, unit="%", entity=" aCME  co"), dict(n=1.0, unit="%", entity="Acme Co"), "corroborates"),
    (dict(kind="status", state="Profitable"), dict(kind="status", state="profitable"), "corroborates"),
    (dict(kind="status", state="listed"), dict(kind="status", state="delisted"), "needs_adjudication"),
    (dict(kind="qualitative"), dict(kind="qualitative"), "needs_adjudication"),
    (dict(c="gt", n=100.0, unit="units"), dict(n=50.0, unit="units"), "needs_adjudication"),
    (dict(n=100.0, unit="units", label="the period"), dict(n=100.0, unit="units", label="that period"), "needs_adjudication"),
]


def test_precheck(spark):
    a = spark.createDataFrame([fact(i, **x) for i, (x, _, _) in enumerate(PAIRS)], FACT)
    b = spark.createDataFrame([fact(i, **y) for i, (_, y, _) in enumerate(PAIRS)], FACT)
    left = precheck.comparable(a).select("fact_id", F.col("cmp").alias("x"))
    right = precheck.comparable(b).select("fact_id", F.col("cmp").alias("y"))
    out = left.join(right, "fact_id").select("fact_id", precheck.decide(F.col("x"), F.col("y")).alias("d"), precheck.decide(F.col("y"), F.col("x")).alias("e")).collect()
    for r in out:
        assert r["d"]["outcome"] == r["e"]["outcome"] == PAIRS[r["fact_id"]][2], (PAIRS[r["fact_id"]], r["d"])


def test_chunks(spark):
    pages = [(1, 1, " first page ", "text_native"), (1, 2, "  ", "text_native"), (1, 3, "", "image_only"), (1, 4, "last page", "text_native"), (1, 5, "gone", "empty"), (1, 6, "end", "text_native")]
    df = spark.createDataFrame(pages, "document_id int, page_number int, text string, content_type string")
    got = [(r["page_number"], r["chunk_index"], r["text"], r["char_start"], r["char_end"], r["leading_context"]) for r in chunking.build_chunks(df).orderBy("page_number").collect()]
    assert got == [(1, 0, "first page", 0, 10, ""), (3, 1, "", 16, 16, "first page"), (4, 2, "last page", 18, 27, "first page"), (6, 3, "end", 35, 38, "last page")]


def test_batches(spark):
    rng = random.Random(3)
    rows = [(d, i, "x" * rng.choice([10, 3000, 12_000]), rng.choice([None, None, "| t |"])) for d in range(4) for i in range(30)]
    out = chunking.plan_batches(spark.createDataFrame(rows, "document_id int, chunk_index int, text string, table_markdown string")).collect()
    groups = {}
    for r in out:
        groups.setdefault((r["document_id"], r["batch"]), []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in g] == list(range(g[0]["chunk_index"], g[0]["chunk_index"] + len(g)))
        assert len(g) == 1 or (len(g) <= 6 and sum(len(r["text"]) for r in g) <= 10_000 and not any(r["table_markdown"] for r in g))


def test_phases(spark):
    df = spark.createDataFrame([(d, p) for d, n in ((1, 30), (2, 95)) for p in range(n)], "document_id int, page_number int")
    got = {(r["document_id"], r["phase"]): r["count"] for r in chunking.phases(df).groupBy("document_id", "phase").count().collect()}
    assert got == {(1, 1): 30, (2, 1): 20, (2, 2): 75}
    assert [r[0] for r in spark.createDataFrame([(0,), (10,), (100,), (1000,)], "n int").select(chunking.budget_seconds(F.col("n"))).collect()] == [600, 600, 800, 8000]


def test_routing_and_tables(spark):
    table = (([["Item", "Amount"], ["Rent", "12.5"], ["Food", "7.25"], ["Fuel", ""], ["x", "1,100"]]), (0.0, 0.0, 10.0, 10.0))
    wide = ([["a", "b", "c"]] * 4, (0.0, 0.0, 1.0, 1.0))
    base = dict(width=600.0, height=800.0, char_count=500, image_area_ratio=0.0, image_count=0, drawing_count=0, digit_ratio=0.0, numeric_line_count=0, table_scan_skipped=False, tables=[])
    cases = [({}, "text_native"), (dict(char_count=3), "empty"), (dict(char_count=20, image_count=1), "image_only"), (dict(char_count=3, drawing_count=9), "text_native"), (dict(tables=[table]), "text_native"), (dict(tables=[wide]), "table_heavy"), (dict(digit_ratio=0.2, numeric_line_count=6), "table_heavy"), (dict(tables=[(table[0], (0.0, 0.0, 600.0, 400.0))]), "table_heavy")]
    schema = "i int, width double, height double, char_count int, image_area_ratio double, image_count int, drawing_count int, digit_ratio double, numeric_line_count int, table_scan_skipped boolean, tables array<struct<rows:array<array<string>>,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    assert [r["content_type"] for r in routing.classify_page(df).orderBy("i").collect()] == [k for _, k in cases]
    contents = [["1 Intro", "... 3"], ["Methods", "... 5"], ["Results", ".9"], ["End", "12"]]
    rows = [(table[0],), ([["a", "b"]],), (contents,), ([["", ""], ["", "x"]],)]
    t = spark.createDataFrame(rows, "r array<array<string>>")
    assert [r[0] for r in t.select(routing.accept_table(F.col("r"))).collect()] == [True, False, False, False]
    assert [r[0] for r in t.select(routing.header_rows(F.col("r"))).collect()][:2] == [1, 0]
    assert t.select(routing.markdown(F.col("r"))).first()[0].split("\n")[:3] == ["| Item | Amount |", "| --- | --- |", "| Rent | 12.5 |"]
    dirty = spark.createDataFrame([([[" a\nb ", None], [None, " "]],)], "r array<array<string>>")
    assert dirty.select(routing.clean_rows(F.col("r"))).first()[0] == [["a b", ""]]


def test_anchor(spark):
    body = "Intro. The “net  margin” was 6.5% in\nthe year to March and rose."
    rows = [("The “net  margin”", body, 100), ('the "net margin" was 6.5%', body, 100), ("The margin rose in the year to March", body, 0), ("absent words here", body, 0), (" ", body, 0), (None, body, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, evidence_text string, text string, char_start int")
    got = {r["i"]: (r["anchor_start"], r["anchor_end"], r["exact"]) for r in grounding.anchor(df).collect()}
    assert got[0] == (107, 124, True)
    assert got[1][2] is False and body[got[1][0] - 100 : got[1][1] - 100] == "The “net  margin” was 6.5%"
    assert got[2][2] is False and body[got[2][0] : got[2][1]].startswith("The") and body[: got[2][1]].endswith("March")
    assert got[3] == got[4] == got[5] == (None, None, None)


def test_nearest_in_small_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("p", "k", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [("p", "k", 900, None), ("p", "j", 901, [1.0] * 4)]
    df = spark.createDataFrame(rows, "project_id string, fact_kind string, fact_id long, embedding array<double>")
    want = {tuple(r) for r in candidates.nearest(df, k=5, most=0.3).select("fact", "other", "rank").collect()}
    monkeypatch.setattr(candidates, "BLOCK", 16)
    assert {tuple(r) for r in candidates.nearest(df, k=5, most=0.3).select("fact", "other", "rank").collect()} == want and want


def test_concepts(spark):
    pairs = [("EBITDA", "ebitda ", "exact", True), ("growth of GDP", "GDP growth", "exact", True), ("EBITDA", "number of employees", "disjoint", False), ("net revenue", "revenue from sales", "model", None)]
    df = spark.createDataFrame([p[:2] for p in pairs], "label_a string, label_b string")
    decided = concepts.decide(df)
    got = {r["label_b"]: (r["method"], r["same"]) for r in decided.collect()}
    assert got == {p[1]: p[2:] for p in pairs}
    answers = spark.createDataFrame([("net revenue", "revenue from sales", True, "revenue", None)], "label_a string, label_b string, same_concept boolean, answered_name string, error string")
    assert {r["canonical_name"] for r in concepts.with_answers(decided, answers).where("method = 'model'").collect()} == {"revenue"}
    assert {r["method"] for r in concepts.with_answers(decided, answers.limit(0)).collect()} == {"exact", "disjoint", "model_error"}


def test_clusters():
    f = clusters.Fold()
    assert f.add([1, 0, 0]) == ("sc_1", 1.0, False)
    assert f.add([0.95, 0.31, 0])[::2] == ("sc_1", False)
    assert f.add([0, 0, 1])[::2] == ("sc_2", True)
    assert f.sizes == [2, 1] and abs((f.centres[0] ** 2).sum() - 1) < 1e-12


def test_verification(spark):
    cases = [(False, None, None, None, None, None, "rejected"), (True, "supported", 0.9, None, None, None, "verified"), (True, "supported", 0.4, None, None, None, "needs_review"), (True, None, None, None, None, None, "needs_review"), (True, "not_supported", 0.9, "unit", "supported", 0.8, "auto_corrected"), (True, "not_supported", 0.9, "unit", "not_supported", 0.8, "needs_review"), (True, "not_supported", 0.9, "unit", None, None, "needs_review")]
    df = spark.createDataFrame([(i, *c[:6], "r", None, None) for i, c in enumerate(cases)], "fact_id int, grounded boolean, verdict_1 string, confidence_1 double, correction string, verdict_2 string, confidence_2 double, reason string, error_1 string, error_2 string")
    assert [r["verification_status"] for r in verification.verify(df).orderBy("fact_id").collect()] == [c[-1] for c in cases]
    logs = verification.log_entries(df).groupBy("fact_id").count().collect()
    assert {r["fact_id"]: r["count"] for r in logs} == {0: 1, 1: 2, 2: 2, 3: 2, 4: 3, 5: 3, 6: 3}
    scores = spark.createDataFrame([(True, []), (False, []), (True, ["a"] * 2), (False, ["a"]), (False, ["a"] * 9)], "a boolean, f array<string>")
    assert [r[0] for r in scores.select(verification.dual_score(F.col("a"), F.col("f"))).collect()] == pytest.approx([0.9, 0.5, 0.7, 0.4, 0.05])


def test_provider(spark):
    requests = spark.createDataFrame([(k,) for k in "abcd"], "request_key string")
    responses = "request_key string, text string, provider string, error_type string"
    first = spark.createDataFrame([("a", "A", "one", None), ("b", None, "one", "timeout"), ("c", None, "one", "schema")], responses)
    second = spark.createDataFrame([("b", "B", "two", None)], responses)
    got = {r["request_key"]: (r["text"], r["error_type"]) for r in provider.answer(requests, first, second).collect()}
    assert got == {"a": ("A", None), "b": ("B", None), "c": (None, "schema"), "d": (None, "missing")}
    assert {r["request_key"]: r["error_type"] for r in provider.answer(requests, first, second.limit(0)).collect()}["b"] == "all_unavailable"


def test_relationships_and_tables(spark):
    edges = spark.createDataFrame([("a", "b", "corroborates", 0.9, 1), ("b", "c", "contradicts", 0.5, 1)], "fact_id_a string, fact_id_b string, type string, confidence double, created_at int")
    new = spark.createDataFrame([("a", "b", "contradicts", 0.7, 2), ("a", "b", "unrelated", 0.6, 3)], edges.schema)
    out = {(r["fact_id_a"], r["fact_id_b"]): r["type"] for r in relationships.upsert(edges, new).collect()}
    assert out == {("a", "b"): "unrelated", ("b", "c"): "contradicts"}
    assert [r["fact_id_a"] for r in relationships.listed(edges, least=0.6).collect()] == ["a"]
    with pytest.raises(ValueError):
        relationships.listed(edges, kind="none")
    files = spark.createDataFrame([("p", "1", b""), ("p", "2", b"%PDF-x"), ("p", "3", b"%PDF-x"), ("p", "4", b"text"), ("p", "5", b"%PDF-y")], "project_id string, path string, content binary")
    known = files.where("path = '5'").select("project_id", F.sha2("content", 256).alias("content_hash"))
    assert {r["path"]: r["reject_reason"] for r in tables.intake(files, known).collect()} == {"1": "empty", "2": None, "3": "duplicate", "4": "not a PDF", "5": "duplicate"}


def test_scope(spark):
    df = spark.createDataFrame([], TABLES["facts"])
    one = Scope("00000000-0000-0000-0000-000000000001")
    assert "project_id" in one.table(df)._jdf.queryExecution().toString()
    for bad in ("x", ""):
        with pytest.raises(ValueError):
            Scope(bad)
    with pytest.raises(ValueError):
        one.table(df.drop("project_id"))


def test_search(spark):
    chunks = spark.createDataFrame([(1, 0, "a" * 300 + " The Licence holds " + "b" * 300), (2, 0, "none")], "document_id int, chunk_index int, text string")
    (r,) = search.passages(chunks, "licence").collect()
    assert "The Licence holds" in r["snippet"] and len(r["snippet"]) < 380


def test_cells_out_of_reach_do_not_meet(spark, monkeypatch):
    rng = random.Random(9)
    axis = lambda i: [1.0 if j == i % 6 else 0.0 for j in range(6)]
    rows = [("p", "k", i, [x + rng.gauss(0, 0.02) for x in axis(i)]) for i in range(240)] + [("p", "j", 500 + i, axis(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "project_id string, fact_kind string, fact_id long, embedding array<double>")
    found = lambda: {tuple(r) for r in candidates.nearest(df, k=4, most=0.2, of=F.col("fact_id") % 3 != 1, among=F.col("fact_id") != 7).select("fact", "other", "rank").collect()}
    want = found()
    monkeypatch.setattr(candidates, "BLOCK", 16)
    monkeypatch.setattr(candidates, "PIVOTS", 24)
    assert found() == want and len(want) > 500
    monkeypatch.setattr(candidates, "MOST_BROADCAST", 0)
    assert found() == want
    named = df.select("project_id", "fact_kind", F.col("fact_id").alias("id"), "embedding", F.lit(True).alias("asks"), F.lit(True).alias("found"))
    copies = lambda reach: candidates._dealt(named, ("project_id", "fact_kind"), reach)[0].count()
    assert copies(0.6) < 0.4 * copies(None)
