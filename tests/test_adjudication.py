"""Adjudication, views and the changes of a verification, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import adjudication, clusters, extraction, provider, verification, views
from factloom.operators.clusters import Fold
from factloom.plans import queries

PAIR = "fact_id_a int, fact_id_b int"
ANSWER = f"{PAIR}, text string, error_type string"


def payload(type_, **more):
    return json.dumps({"relationship_type": type_, "reconciliation_basis": "period", "explanation": " why ", "confidence": 0.4, "needs_more_context": False, "missing_context": None, "entity_match": "same"} | more)


def test_verdicts(spark):
    rows = [
        (0, payload("contradicts"), None), (1, payload("reconciled_by_context", confidence=7), None), (2, payload("corroborates", confidence=-1, needs_more_context=True, missing_context="year"), None),
        (3, payload("nonsense"), None), (4, "no json", None), (5, None, "timeout"), (7, payload("unrelated", confidence=None, reconciliation_basis=""), None), (8, "[1]", None),
    ]
    pairs = spark.createDataFrame([(i, i + 100) for i in range(9)], PAIR)
    answers = spark.createDataFrame([(i, i + 100, t, e) for i, t, e in rows], ANSWER)
    got = {r["fact_id_a"]: (r["error"], r["type"], r["basis"], r["confidence"], r["needs_more_context"], r["missing_context"]) for r in adjudication.verdicts(pairs, answers).collect()}
    bad = lambda e: (e, None, None, None, None, None)
    assert got == {
        0: (None, "contradicts", None, 0.4, False, None), 1: (None, "reconciled_by_context", "period", 1.0, False, None), 2: (None, "corroborates", None, 0.0, True, "year"),
        3: bad("invalid"), 4: bad("invalid"), 5: bad("timeout"), 6: bad("missing"), 7: (None, "unrelated", None, 0.0, False, None), 8: bad("invalid"),
    }
    final = {r["fact_id_a"]: (r["needs_more_context"], r["missing_context"], r["explanation"], r["reasoning"]) for r in adjudication.verdicts(pairs, answers, final=True).collect()}
    assert final[2][:3] == (False, None, "why") and final[2][3]["entity_match"] == "same"


def test_the_look_for_context(spark):
    use = lambda tool, q="q": json.dumps({"action": "use_tool", "tool": tool, "query": q, "fact_id": None, "rationale": "r"})
    stop = json.dumps({"action": "finish", "tool": None, "query": None, "fact_id": None, "rationale": "enough"})
    plans = {1: [use("search_facts"), use("search_evidence_text"), use("search_facts", "gone"), use("search_facts")], 2: [stop, use("search_facts")], 3: [use("guess")], 4: [use("search_facts"), ("rate_limit",)], 5: [], 6: [use("search_facts"), stop], 7: [use("search_facts"), "I would stop here"], 8: ["[1]"], 9: ['{"action": "finish"} or so']}
    steps = [(p, 0, k + 1, *((None, s[0]) if isinstance(s, tuple) else (s, None))) for p, given in plans.items() for k, s in enumerate(given)]
    results = spark.createDataFrame([("search_facts", "q", None, "x" * 5000), ("search_evidence_text", "q", None, "found")], "tool string, query string, fact_id string, output string")
    pairs = spark.createDataFrame([(p, 0) for p in plans], PAIR)
    final = spark.createDataFrame([(p, 0, payload("unrelated" if p == 2 else "contradicts", needs_more_context=True), None) for p in plans if p != 6], ANSWER)
    out = {r["fact_id_a"]: r for r in adjudication.reconcile(pairs, spark.createDataFrame(steps, f"{PAIR}, step int, text string, error_type string"), results, final).collect()}
    assert {p: (r["tool_calls"], r["budget_exhausted"], len(r["trail"])) for p, r in out.items()} == {1: (3, True, 4), 2: (0, False, 2), 3: (0, False, 2), 4: (1, False, 3), 5: (0, False, 2), 6: (1, False, 3), 7: (1, False, 3), 8: (0, False, 2), 9: (0, False, 2)}
    assert [out[p]["trail"][-2]["error"] for p in (7, 8, 9)] == ["no JSON object"] * 3 and out[7]["trail"][1]["action"] is None
    assert [len(e["result"] or "") for e in out[1]["trail"]] == [2000, 5, 0, 0] and out[1]["findings"] == "[search_facts] " + "x" * 5000 + "\n\n[search_evidence_text] found\n\n[search_facts] "
    assert [e["error"] for e in out[3]["trail"]][0] == "invalid tool guess" and out[4]["trail"][1]["error"] == "rate_limit" and out[5]["trail"][0]["error"] == "missing"
    assert out[2]["findings"] == "(no additional context could be found)" and out[2]["trail"][0]["rationale"] == "enough"
    assert [(e["action"], e["verdict"], e["step"]) for e in out[1]["trail"]][-1] == ("final_classification", "contradicts", 4) and out[6]["error"] == "missing"
    first = spark.createDataFrame([(p, 0, payload("corroborates", needs_more_context=p < 6), None) for p in plans], ANSWER)
    edges = {r["fact_id_a"]: (r["type"], len(r["trail"])) for r in adjudication.adjudicate(pairs, first, spark.createDataFrame(steps, f"{PAIR}, step int, text string, error_type string"), results, final).collect()}
    assert edges == {1: ("contradicts", 4), 2: ("unrelated", 2), 3: ("contradicts", 2), 4: ("contradicts", 3), 5: ("contradicts", 2), 6: ("corroborates", 0), **{p: ("corroborates", 0) for p in (7, 8, 9)}}
    assert {r["fact_id_a"] for r in adjudication.adjudicate(pairs, final).collect()} == {1, 3, 4, 5, 7, 8, 9}  # unrelated at once makes no edge


def test_a_verification_is_applied(spark):
    fields = "entity string, attribute string, value struct<number:double>, period struct<raw_label:string>, qualifiers map<string,string>"
    change = "array<struct<fact_id:int,corrected_by:string,changes:map<string,struct<old:string,new:string>>>>"
    facts = spark.createDataFrame([(i, "A", "b", (1.0,), ("FY24",), {"k": "v"}, "pending", None, None if i else ["old"], None) for i in range(4)], f"fact_id int, {fields}, verification_status string, verifier_confidence double, notes array<string>, corrections {change}")
    rows = [(0, "verified", 0.9, "fine", None), (1, "auto_corrected", 0.8, None, ("B", "b", (2.0,), ("FY24",), {"k": "v"})), (2, "auto_corrected", 0.8, "same", ("A", "b", (1.0,), ("FY24",), {"k": "v"})), (9, "verified", 1.0, None, None)]
    verified = spark.createDataFrame(rows, f"fact_id int, verification_status string, verifier_confidence double, note string, corrected struct<{fields.replace(' string', ':string').replace(' struct', ':struct').replace(' map', ':map')}>")
    out = {r["fact_id"]: r for r in verification.apply(facts, verified).collect()}
    assert {i: (r["verification_status"], r["verifier_confidence"], r["entity"], r["notes"]) for i, r in out.items()} == {0: ("verified", 0.9, "A", ["old", "fine"]), 1: ("auto_corrected", 0.8, "B", []), 2: ("auto_corrected", 0.8, "A", ["same"]), 3: ("pending", None, "A", [])}
    assert [len(out[i]["corrections"]) for i in range(4)] == [0, 1, 0, 0] and set(out[1]["corrections"][0]["changes"]) == {"entity", "value"}


def test_a_projects_reads(spark):
    when = F.timestamp_seconds("n")
    docs = spark.createDataFrame([("p", "d1", "a.pdf", "h1", 1), ("p", "d2", "b.pdf", "h2", 2), ("q", "d3", "c.pdf", "h3", 3)], "project_id string, document_id string, filename string, content_hash string, n int").withColumn("created_at", when).drop("n")
    facts = spark.createDataFrame([("p", "f1", "d1", " Acme ", "verified"), ("p", "f2", "d1", "Acme", "pending"), ("p", "f3", "d2", " ", "verified"), ("q", "f4", "d3", "Zed", "verified")], "project_id string, fact_id string, document_id string, entity string, verification_status string").withColumn("created_at", F.timestamp_seconds(F.lit(1)))
    edges = spark.createDataFrame([("p", "r1", "f1", "f2", "contradicts", 0.5), ("p", "r2", "f1", "f3", "corroborates", 0.9), ("p", "r3", "f1", "gone", "unrelated", 0.1)], "project_id string, relationship_id string, fact_id_a string, fact_id_b string, type string, confidence double")
    chunks = spark.createDataFrame([("p", "d1", 0)], "project_id string, document_id string, chunk_index int")
    p = views.Project("p", {"documents": docs, "facts": facts, "fact_relationships": edges, "chunks": chunks})
    assert [r["document_id"] for r in p.documents().collect()] == ["d2", "d1"] and p.document("d3").count() == 0 and p.document_by_hash("h2").first()["document_id"] == "d2"
    got = {r["document_id"]: (r["chunk_count"], r["fact_count"], r["facts_by_status"], r["relationship_count"]) for r in p.status().collect()}
    assert got == {"d1": (1, 2, {"verified": 1, "pending": 1}, 3), "d2": (0, 1, {"verified": 1}, 1)}
    assert p.status("d2").count() == 1 and [r["fact_id"] for r in p.facts(entity="Acme").collect()] == ["f2"] and p.fact("f4").count() == 0
    assert [r["relationship_id"] for r in p.relationships(least=0.2).collect()] == ["r2", "r1"] and p.relationship("r1").count() == 1 and p.relationship("r3").count() == 0
    assert {tuple(r) for r in p.counts().collect()} == {("facts", "verified", 2), ("facts", "pending", 1), ("relationships", "contradicts", 1), ("relationships", "corroborates", 1), ("relationships", "unrelated", 1)}
    assert {tuple(r) for r in p.vocabulary().collect()} == {("d1", "Acme")}
    named = {r["fact_id"]: r["filename"] for r in views.with_document_name(facts, docs.where("document_id <> 'd2'")).collect()}
    assert named == {"f1": "a.pdf", "f2": "a.pdf", "f3": "?", "f4": "c.pdf"}
    with pytest.raises(ValueError):
        views.sort_key("colour")


def test_missing_embeddings(spark):
    seen = []
    rows = [(i, "e", str(i % 70), {"b": "2", "a": "1"} if i % 2 else None, [0.5] if i % 10 == 0 else None) for i in range(300)]
    facts = spark.createDataFrame(rows, "fact_id int, entity string, attribute string, qualifiers map<string,string>, embedding array<float>")

    def embed(texts):
        seen.append(len(texts))
        assert len(texts) <= 64
        return [[len(t) / 1.0] for t in texts]

    out = {r["fact_id"]: r["embedding"] for r in provider.embed_missing(facts, embed).collect()}
    assert len(out) == 300 and out[10] == [0.5] and out[1] == [float(len("e | 1 | a: 1 | b: 2"))]


def test_profiles_follow_the_fold(spark, sf):
    rows = {r["project_id"]: r for r in queries.QUERIES["project_profiles"](spark, sf).collect()}
    docs = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        docs.setdefault(r["label"], []).append(r["embedding"])
    assert set(rows) == set(docs)
    for label, vectors in docs.items():
        centre, n, fold = None, 0, Fold(join=0.3)
        for v in vectors:
            whole = [x + n * c for x, c in zip(v, centre or [0.0] * len(v))]
            whole = [x / (n + 1) for x in whole]
            size = sum(x * x for x in whole) ** 0.5
            centre, n = [x / size for x in whole], n + 1
            fold.add(v)
        assert rows[label]["document_count"] == n and rows[label]["sizes"] == fold.sizes
        assert max(abs(a - b) for a, b in zip(rows[label]["centre"], centre)) < 1e-6


def test_extraction_answers(spark):
    batches = spark.createDataFrame([(k,) for k in "abcdef"], "request_key string")
    row = "request_key string, text string, provider string, error_type string"
    first = spark.createDataFrame([("a", '{"facts": [{"entity": "x", "number": 1.5}, 3]}', "p", None), ("b", None, "p", extraction.SCHEMA_ERROR), ("c", None, "p", "timeout"), ("d", '{"facts": 3}', "p", None), ("e", None, "p", extraction.SCHEMA_ERROR)], row)
    free = spark.createDataFrame([("b", '{"facts": []}', "p", None), ("a", '{"facts": []}', "p", None)], row)
    out = extraction.ask(batches, first, free)
    assert {r["request_key"]: (r["error_type"], r["calls"], r["failed"]) for r in out.collect()} == {"a": (None, 1, False), "b": (None, 2, False), "c": ("timeout", 1, True), "d": ("no facts", 1, True), "e": ("missing", 2, True), "f": ("missing", 1, True)}
    got = [r["fact"] for r in extraction.proposed(out, "entity string, number double").collect()]
    assert (got[0]["entity"], got[0]["number"]) == ("x", 1.5)


def test_vocabulary_is_by_first_document(spark):
    docs = spark.createDataFrame([("p", "d1", 5), ("p", "d2", 1)], "project_id string, document_id string, created_at int")
    facts = spark.createDataFrame([("d1", "A"), ("d1", " A "), ("d2", "A"), ("d1", "B"), ("d2", " "), ("gone", "C")], "document_id string, entity string")
    assert {(r["term"], r["document_id"]) for r in clusters.vocabulary(docs, facts).collect()} == {("A", "d2"), ("B", "d1")}
