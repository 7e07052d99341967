"""Comparing a document to its last edge: rules, verdicts, looks, concepts, trails, statistics."""

import json

from pyspark.sql import functions as F

from factloom.operators import compare, concepts
from factloom.schemas import VALUE

FACT = f"project_id string, fact_id int, document_id string, fact_kind string, entity string, attribute string, value {VALUE}, period struct<raw_label:string>, qualifiers map<string,string>, entity_resolved boolean, embedding array<double>, verification_status string"
ANSWER = "fact_id_a int, fact_id_b int, text string, error_type string"


def fact(i, n, at, project="p", document="d1", entity="Acme", status="verified", unit="kg", label="FY24"):
    return (project, i, document, "quantitative", entity, "Revenue", ("eq", n, None, unit, None, None), (label,), {}, True, at, status)


def said(kind, **more):
    return json.dumps({"relationship_type": kind, "reconciliation_basis": "period", "explanation": "e", "confidence": 0.5, **more})


def test_to_the_last_edge(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [
        fact(1, 5.0, a), fact(2, 5.0, a, document="d2"),  # agree
        fact(3, 5.0, a, document="d2", entity="Acme Corp"), fact(4, 9.0, a, document="d2", unit="%"),  # one name with 1; another dimension
        fact(5, 7.0, b), fact(6, 8.0, b, document="d2"),  # a model says they contradict
        fact(7, 7.0, c), fact(8, 8.0, c, document="d2"), fact(9, 9.0, c, document="d2"),  # a look, an error
        fact(1, 5.0, a, project="q"), fact(2, 6.0, a, project="q", status="rejected"),
    ]
    facts = spark.createDataFrame(rows, FACT)
    verdicts = [(5, 6, said("contradicts"), None), (7, 8, said("corroborates", needs_more_context=True), None), (7, 9, None, "timeout")]
    steps = spark.createDataFrame([(7, 8, 1, json.dumps({"action": "use_tool", "tool": "search_facts", "query": "q"}), None), (7, 8, 2, json.dumps({"action": "finish"}), None)], "fact_id_a int, fact_id_b int, step int, text string, error_type string")
    results = spark.createDataFrame([("search_facts", "q", None, "found")], "tool string, query string, fact_id string, output string")
    final = spark.createDataFrame([(7, 8, said("unrelated"), None)], ANSWER)
    labels = spark.createDataFrame([("entity", "Acme", "Acme Corp", True, "Acme Corporation", None)], "kind string, label_a string, label_b string, same_concept boolean, answered_name string, error string")
    edges = spark.createDataFrame([(1, 4)], "fact_id_a int, fact_id_b int")
    new = facts.where("document_id = 'd1' AND project_id = 'p'").select("fact_id")
    answers = compare.Answers(spark.createDataFrame(verdicts, ANSWER), labels, steps, results, final)
    out = compare.compare_document(facts.where("project_id = 'p'"), edges, answers, new)
    got = {(r["fact_id_a"], r["fact_id_b"]): r for r in out.edges.collect()}
    assert {k: (r["type"], r["confidence"], len(r["trail"])) for k, r in got.items()} == {
        (1, 2): ("corroborates", 0.95, 1), (1, 3): ("corroborates", 0.95, 1), (5, 6): ("contradicts", 0.5, 1), (7, 8): ("unrelated", 0.5, 4),
    }
    first = got[1, 2]["trail"][0]
    assert (first["step"], first["method"], first["reason"]) == (0, "deterministic_precheck", None) and json.loads(first["detail"])["low_a"] == "4.5"
    assert got[5, 6]["trail"][0]["reason"] == "intervals do not overlap" and [e["step"] for e in got[7, 8]["trail"]] == [0, 1, 2, 3]
    (stats,) = out.statistics.collect()
    assert {k: v for k, v in stats.asDict().items() if k != "project_id"} == {
        "facts_considered": 3, "candidate_pairs": 5, "precheck_corroborates": 2, "precheck_not_comparable": 0, "adjudicated": 2, "adjudication_errors": 1, "reconciled": 1,
        "by_type": {"contradicts": 1, "corroborates": 2, "unrelated": 1},
    }
    merged = {(r["kind"], r["label_a"], r["label_b"], r["canonical_name"]) for r in out.merges.collect()}
    assert ("entity", "Acme", "Acme Corp", "Acme Corporation") in merged and ("attribute", "Revenue", "Revenue", "Revenue") in merged
    none = spark.createDataFrame([], "project_id string, kind string, canonical_name string, raw_aliases array<string>, first_seen_document_id string, first_seen_at timestamp")
    known = {(r["kind"], r["canonical_name"]): r["raw_aliases"] for r in concepts.upsert(none, compare.seen(out.merges, F.timestamp_seconds(F.lit(1)))).collect()}
    assert known["entity", "Acme Corporation"] == ["Acme", "Acme Corp"]

    again = compare.compare_document(facts.where("project_id = 'p'"), out.edges.select("fact_id_a", "fact_id_b").unionByName(edges), answers, new)
    assert [tuple(r) for r in again.pairs.select("fact_id_a", "fact_id_b").collect()] == [(7, 9)] and again.edges.count() == 0
    plain = compare.compare_document(facts, edges, answers, reconcile=False)
    kinds = {(r["project_id"], r["fact_id_a"], r["fact_id_b"]): r["type"] for r in plain.edges.collect()}
    assert kinds["p", 7, 8] == "corroborates" and not any(p == "q" for p, *_ in kinds)


def test_few_and_near_facts_of_a_strange_document(spark):
    turn = lambda x: [1 - x, x, 0.0]
    facts = spark.createDataFrame([fact(0, 5.0, turn(0.0))] + [fact(i, 5.0, turn(i / 16), document="d2") for i in range(1, 12)], FACT)
    none = spark.createDataFrame([], "fact_id_a int, fact_id_b int")
    answers = compare.Answers(spark.createDataFrame([], ANSWER))
    of = lambda **more: compare.compare_document(facts, none, answers, facts.where("fact_id = 0"), **more).pairs
    assert of().count() == 8 and of(off_domain=True).count() == 3
    empty = compare.compare_document(facts.limit(0), none, answers)
    assert empty.edges.count() == empty.statistics.count() == empty.merges.count() == 0
