"""Answers and their fallbacks."""

import json

from factloom.operators import search

FACT = "answer_id int, fact_id string, fact_kind string, entity string, attribute string"


def test_answers(spark):
    facts = [(q, f"{q}-{i}", kind, entity, "x") for q in (1, 2, 3, 4, 5) for i, (kind, entity) in enumerate([("status", "A"), ("quantitative", "b"), ("quantitative", "A")])]
    facts = [f for f in facts if f[0] != 5]
    said = lambda answer, *cited: json.dumps({"answer": answer, "cited_markers": cited})
    answers = [(1, said(" Grew [F1], see [F7]. ", "F3", "F9"), None), (2, None, "timeout"), (3, "[1]", None), (5, said("made up [F1]", "F1"), None), (6, said("x"), None)]
    edges = [("1-0", "1-1", "contradicts", "period", "e"), ("1-1", "1-2", "corroborates", None, None), ("1-2", "2-0", "contradicts", None, None), ("2-2", "2-1", "reconciled_by_context", None, "r")]
    out = {
        r["answer_id"]: r
        for r in search.synthesise(
            spark.createDataFrame([(i,) for i in range(1, 6)], "answer_id int"), spark.createDataFrame(facts, FACT),
            spark.createDataFrame(edges, "fact_id_a string, fact_id_b string, type string, basis string, explanation string"), spark.createDataFrame(answers, "answer_id int, text string, error_type string"),
        ).collect()
    }
    cited = {i: [(c["marker"], c["fact_id"]) for c in r["citations"]] for i, r in out.items()}
    every = lambda q: [("F1", f"{q}-2"), ("F2", f"{q}-1"), ("F3", f"{q}-0")]
    assert (out[1]["answer"], out[1]["error"], cited[1]) == ("Grew [F1], see [F7].", None, [("F1", "1-2"), ("F3", "1-0")])
    assert [tuple(d) for d in out[1]["disagreements"]] == [("F3", "F2", "contradicts", "period", "e")]
    assert (out[2]["answer"], out[2]["error"], cited[2]) == (search.FAILED, "timeout", every(2)) and len(out[2]["disagreements"]) == 1
    assert (out[3]["error"], cited[3]) == ("no JSON object", every(3)) and (out[4]["error"], cited[4]) == ("missing", every(4))
    assert (out[5]["answer"], out[5]["error"], cited[5], out[5]["disagreements"]) == (search.NO_FACTS, None, [], []) and len(out) == 5
