"""Grounding and anchoring against plain Python."""

import random

from pyspark.sql import functions as F

from factloom.operators import grounding


def form(text):
    import re

    joined = re.sub(r"-[ \t]*\n[ \t]*", "", text)
    plain = joined.translate(str.maketrans("‘’‚‛“”–—−", "''''\"\"---")).translate({0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None})
    return " ".join(plain.lower().split())


def test_last_word_is_its_last_place(spark):
    rows = [("alpha x beta", "alpha one beta two beta tail", 0), ("alpha x beta", "alpha one beta two beta tail", 100), ("a b", "a c b", 0), ("one two three", "one " + "z " * 200 + "three", 0), ("Acme  grew", "In 2020 acme grew.", 0), ("x", None, 0), (None, "x", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, evidence_text string, text string, char_start int")
    got = {r["i"]: (r["anchor_start"], r["anchor_end"], r["exact"]) for r in grounding.anchor(df).collect()}
    none = (None, None, None)
    assert got == {0: (0, 23, False), 1: (100, 123, False), 2: none, 3: none, 4: (8, 17, False), 5: none, 6: none}


def test_grounded_places_in_the_raw_text(spark):
    rows = [
        ("co-operation grew", "The coop-\neration; co-operation\u200b   grew “fast”"), ("cooperation grew", "All co-\n  operation grew fast"), ("\"fast\" – growth", "a “fast”  - growth b"), ("abc", "abc"),
        ("word", "word " * 6), ("not there", "nothing"), ("A\u00a0LONG   phrase that is found once", "x a long phrase\nthat is found once y"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, evidence_text string, text string")
    out = {r["i"]: r for r in grounding.ground(df).collect()}
    assert [out[i]["passed"] for i in range(len(rows))] == [True, True, True, False, False, False, True]
    assert [out[i]["reason"] for i in (3, 4, 5)] == ["too short", "too generic", "not in source"]
    for i, (e, t) in enumerate(rows):
        r = out[i]
        if r["passed"]:
            assert form(t[r["matched_start"] : r["matched_end"]]) == form(e)
        else:
            assert r["matched_start"] is None


def test_passages_of_any_length_are_found(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["alpha", "be", "gam", "delta", "eps", "zeta", "e1", "theta", "io", "kappa"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(90, None), (91, ""), (92, "xx delta-\nzeta yy")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    items += [(100, "lpha b"), (101, "elta"), (102, "io"), (103, None), (104, "deltazeta"), (105, "DELTA  eps"), (106, "a ga"), (107, "eta io kap"), (108, "delta"), (108, "theta")]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")

    def grounded(e, s):
        e, s = form(e or ""), form(s or "")
        return sum(c.isalnum() for c in e) >= 4 and e in s and not (len(e) < 24 and s.count(e) > 4)

    want = {(i, j) for i, e in items for j, s in docs if grounded(e, s)}
    assert {tuple(r) for r in grounding.find_passages(p, d).collect()} == want and any(len(form(e or "").split()) < 3 for i, e in items if any(i == w for w, _ in want))
    monkeypatch.setattr(grounding, "MOST_BROADCAST", 0)
    assert {tuple(r) for r in grounding.find_passages(p, d).collect()} == want
    assert grounding.find_passages(p.limit(0), d).count() == 0


def test_the_chunk_of_a_batched_fact(spark):
    chunks = spark.createDataFrame([("d", 0, k, k + 10, t) for k, t in enumerate(("first page", "the “second” page", "third  PAGE"))], "document_id string, batch int, chunk_index int, page_number int, text string")
    facts = [(0, 12, "first"), (1, 99, "\"Second\" page"), (2, None, "third page"), (3, None, "page"), (4, None, "nowhere"), (5, None, " "), (6, None, None)]
    df = spark.createDataFrame([(i, "d", 0, p, e) for i, p, e in facts], "fact_id int, document_id string, batch int, source_page int, evidence_text string")
    assert {r["fact_id"]: r["chunk_index"] for r in grounding.batch_chunk(df, chunks).collect()} == {0: 2, 1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}
