"""Repairs and the finalising of proposed facts."""

import re

from pyspark.sql import functions as F

from factloom.functions import repair
from factloom.operators import chunking, extraction
from factloom.plans import queries
from factloom.schemas import VALUE

FACT = f"i int, document_id string, chunk_index int, fact_kind string, entity string, attribute string, value {VALUE}, period struct<raw_label:string>, qualifiers map<string,string>, entity_resolved boolean, evidence_text string, extraction_confidence double"


def fact(i, evidence, n=33250.0, c="eq", kind="quantitative", q=None, entity="Acme", conf=0.9):
    return (i, "d", 0, kind, entity, "Trips", (c, n, None, "trips", "x", "y"), ("the period",), q, True, evidence, conf)


CASES = [
    ("Acme made over 33,250 trips", "eq", "gt"), ("at least 33250 trips in all", "eq", "gte"), ("up to 33,250 trips", None, "lte"), ("fewer than 33,250 trips", "eq", "lt"), ("approximately 33,250 trips", "eq", "approx"), ("~33,250 trips", "eq", "approx"),
    ("more than half of staff, 33,250 trips done", "eq", "eq"), ("33,250 trips; over budget", "eq", "eq"), ("over 33,250 trips", "lte", "lte"), ("33,250 trips", None, "eq"), ("trips rose to over 33,250", "eq", "gt"),
]


def test_comparator_repair(spark):
    df = spark.createDataFrame([fact(i, e, c=c) for i, (e, c, _) in enumerate(CASES)] + [fact(99, "over 33,250", c="eq", kind="status")], FACT)
    got = {r["i"]: (r["value"]["comparator"], r["repaired"]) for r in repair.repair_comparators(df).collect()}
    assert got == {i: (w, w not in ("eq", c)) for i, (_, c, w) in enumerate(CASES)} | {99: ("eq", False)}


def test_corrections(spark):
    issues = [
        [("colour", "", "red"), ("value.number", "", "(1,234) crore")], [("Entity ", "", "x" * 121), ("attribute", "", "Other")], [("value.comparator", "", "at least")], [("value.unit", "", ""), ("period", "", "FY25")], [("value.number", "", "none")], [],
    ]
    df = spark.createDataFrame([(*fact(i, "e"), s) for i, s in enumerate(issues)], FACT + ", issues array<struct<field:string,problem:string,suggested_correction:string>>")
    out = {r["i"]: r for r in repair.apply_correction(df.withColumn("correction", repair.safe_correction(F.col("issues")))).collect()}
    assert out[0]["value"]["number"] == -1234 and out[1]["attribute"] == "Other" and out[1]["entity"] == "Acme"
    assert out[2]["value"]["comparator"] == "gte" and out[3]["period"]["raw_label"] == "FY25" and out[4]["correction"] is None and out[5]["correction"] is None


def test_finalise(spark):
    chunks = spark.createDataFrame([("d", 0, "Acme made over 33,250 trips in  all.", 10, 0.6, None), ("t", 0, "Trips 5", 0, 1.0, "| Trips |")], "document_id string, chunk_index int, text string, char_start int, confidence_ceiling double, table_markdown string")
    rows = [fact(0, "over 33,250 trips"), fact(1, "trips in all."), fact(2, "not there at all"), fact(3, "over 33,250", entity=" "), fact(4, "x", n=None)]
    rows += [(r[0], "t", *r[2:]) for r in (fact(5, "Trips 5", n=5.0), fact(6, "Trips 5", n=5.0, q={"column": "Trips"}))]
    kept, dropped = extraction.finalise(spark.createDataFrame(rows, FACT), chunks)
    got = {r["i"]: (r["value"]["comparator"], r["exact"], r["extraction_confidence"]) for r in kept.collect()}
    assert got == {0: ("gt", True, 0.6), 1: ("eq", False, 0.6), 2: ("eq", None, 0.6), 6: ("eq", True, 0.9)}
    assert {r["i"]: r["drop_reason"] for r in dropped.collect()} == {3: "invalid", 4: "invalid", 5: "no_column_context"}
    stats = {r["document_id"]: (r["candidates_returned"], r["candidates_kept"], r["unanchored"]) for r in extraction.statistics(kept, dropped).collect()}
    assert stats == {"d": (5, 3, 1), "t": (2, 1, 0)}


def test_finalise_counts_facts_whose_chunk_is_missing(spark):
    chunks = spark.createDataFrame([("d", 0, "over 33,250 trips", 0, 1.0, None)], "document_id string, chunk_index int, text string, char_start int, confidence_ceiling double, table_markdown string")
    rows = [fact(0, "over 33,250 trips"), (1, "d", 7, *fact(1, "trips")[3:]), (2, "gone", *fact(2, "trips")[2:]), (3, "gone", *fact(3, "trips", entity="")[2:]), (4, "d", None, *fact(4, "trips")[3:])]
    kept, dropped = extraction.finalise(spark.createDataFrame(rows, FACT), chunks)
    assert [r["i"] for r in kept.collect()] == [0]
    assert {r["i"]: r["drop_reason"] for r in dropped.collect()} == {1: "no_chunk", 2: "no_chunk", 3: "invalid", 4: "no_chunk"}
    stats = {r["document_id"]: (r["candidates_returned"], r["candidates_kept"], r["dropped_no_chunk"], r["dropped_invalid"]) for r in extraction.statistics(kept, dropped).collect()}
    assert stats == {"d": (3, 1, 2, 0), "gone": (2, 0, 1, 1)}


def stands(evidence, text):
    form = lambda s: " ".join(s.translate(str.maketrans("‘’“”–—", "''\"\"--")).lower().split())
    e, t = form(evidence), form(text)
    if evidence in text or e in t:
        return True
    first, last = e.split()[0], e.split()[-1]
    a, b = t.find(first), t.rfind(last)
    return len(e.split()) >= 3 and 0 <= a <= b and b + len(last) - a <= max(3 * len(evidence), 200)


def test_query_finalises_facts_of_every_chunk(spark, sf):
    want = {}
    for r in chunking.build_chunks(queries.classified(spark, sf)).collect():
        d, k, text = r["document_id"], r["chunk_index"], r["text"]
        w = want.setdefault(d, dict.fromkeys(("candidates_kept", "repaired", "unanchored", "dropped_invalid", "dropped_no_chunk", "dropped_no_column_context", "candidates_returned"), 0))
        at, rule, number = len(text) // 3, d + k, 700_000_000 + d % 1000
        cut = text[at : at + 40]
        altered = {0: cut.upper(), 1: f"{cut[:20]} as stated {cut[20:]}", 2: cut[::-1], 3: f"over {number} units, {cut}"}.get(rule % 6, cut)
        for i, evidence in enumerate((cut, altered)):
            w["candidates_returned"] += 1
            if not evidence.strip() or (i and rule % 6 == 4):
                w["dropped_invalid"] += 1
            elif i and rule % 6 == 5:
                w["dropped_no_chunk"] += 1
            elif i and d % 9 == 0 and rule % 7 > 1:
                w["dropped_no_column_context"] += 1
            else:
                w["candidates_kept"] += 1
                w["repaired"] += rule % 7 > 1 and any(re.search(p, evidence, re.I) for _, p in repair.CUES)
                w["unanchored"] += not stands(evidence, text)
    got = {r["document_id"]: r.asDict() for r in queries.finalise_candidates(spark, sf).collect()}
    assert {d: {k: v for k, v in r.items() if k != "document_id"} for d, r in got.items()} == want
    assert len(want) > 50 and all(sum(w[k] for w in want.values()) for k in next(iter(want.values())))


CLAUSES = [
    ("Sales grew; the firm sold more than 1,250 units in all of the year (over plan)", 1250.0, "the firm sold more than 1,250 units in all of"),
    ("5 and 5 units", 5.0, "5 and 5 units"), ("a 1250 b 1,250 c", 1250.0, "a 1250 b 1,250 c"), ("x 11250 y", 1250.0, None), ("1250.5 then", 1250.0, None), ("ends in 1250", 1250.0, None),
    ("about 12.50 km", 12.5, "about 12.50 km"), ("about 1,234.5 km", 1234.5, "about 1,234.5 km"), ("minus 7 now", -7.0, "minus 7 now"), ("no figure", 3.0, None), ("x 3 y", None, None),
    ("first 7, 7 more", 7.0, " 7 more"), ("rate: about 0.05 percent. Over", 0.05, " about 0.05 percent"), (None, 3.0, None), ("12345678901 units", 12345678901.0, "12345678901 units"),
]


def test_clauses(spark):
    df = spark.createDataFrame([(i, e, n) for i, (e, n, _) in enumerate(CLAUSES)], "i int, e string, n double")
    got = {r["i"]: r["c"] for r in df.select("i", repair.clause_around(F.col("e"), F.col("n")).alias("c")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(CLAUSES)}
