"""The evidence view: boxes of anchored, altered and missing evidence, against a plain search."""

import random

from factloom.operators import evidence
from factloom.operators.views import Project

WORD = "document_id string, page_number int, place int, line int, word string, x0 double, y0 double, x1 double, y1 double"
FACT = "project_id string, fact_id string, document_id string, chunk_index int, page_number int, matched_text string, evidence_text string"


def laid(document, page, text, width=5):
    rows = []
    for i, w in enumerate(text.split()):
        line, col = divmod(i, width)
        rows.append((document, page, i, line, w, 10.0 + 50 * col, 20.0 * line, 10.0 + 50 * col + 5 * len(w), 20.0 * line + 12))
    return rows


TEXT = "Revenue grew to 127 crore in FY24 while margins fell to 6.5 percent and revenue grew to 127 crore again at the end"
FACTS = [
    ("p", "anchored", "d", 0, 1, "grew to 127 crore", "x"),
    ("p", "two lines", "d", 0, 1, "crore in FY24 while margins", "x"),
    ("p", "blanks and case", "d", 0, 1, "MARGINS  fell\nto", "x"),
    ("p", "altered anchor", "d", 0, 1, "margins rose", "margins fell to 6.5"),
    ("p", "no anchor", "d", 7, 1, None, "at the end"),
    ("p", "inside a word", "d", 0, 1, "argins f", "x"),
    ("p", "missing", "d", 0, 1, "nowhere", "not here either"),
    ("p", "other page", "d", 0, 2, "grew to", "x"),
    ("p", "no page", "d", 0, 9, "grew to", "x"),
    ("p", "no text", "d", 0, 1, None, None),
    ("p", "blank", "d", 0, 1, " ", ""),
]


def test_boxes(spark):
    words = spark.createDataFrame(laid("d", 1, TEXT) + laid("d", 2, "it grew to") + laid("e", 1, TEXT), WORD)
    facts = spark.createDataFrame(FACTS, FACT)
    got = {r["fact_id"]: [tuple(b) for b in r["boxes"]] for r in evidence.boxes(facts, words).collect()}
    at = lambda i, j, line: (10.0 + 50 * i, 20.0 * line, 10.0 + 50 * j + 5 * len(TEXT.split()[5 * line + j]), 20.0 * line + 12)
    assert got == {
        "anchored": [at(1, 4, 0), at(0, 3, 3)],  # twice on the page
        "two lines": [at(4, 4, 0), at(0, 3, 1)],
        "blanks and case": [at(3, 4, 1), at(0, 0, 2)],
        "altered anchor": [at(3, 4, 1), at(0, 1, 2)],
        "no anchor": [at(0, 2, 4)],
        "inside a word": [at(3, 4, 1)],
        "other page": [(60.0, 0.0, 120.0, 12.0)],
    }


def test_view(spark):
    words = spark.createDataFrame(laid("d", 1, TEXT), WORD)
    tables = {
        "facts": spark.createDataFrame(FACTS, FACT), "documents": spark.createDataFrame([("p", "d", "a.pdf")], "project_id string, document_id string, filename string"),
        "chunks": spark.createDataFrame([("p", "d", 0, "the whole chunk")], "project_id string, document_id string, chunk_index int, text string"),
        "pages": spark.createDataFrame([("p", "d", 1, 200.0, 100.0)], "project_id string, document_id string, page_number int, width double, height double"),
        "words": words.selectExpr("'p' AS project_id", "*"),
    }
    (one,) = Project("p", tables).evidence("two lines").collect()
    assert (one["filename"], one["surrounding_text"], one["page_width"]) == ("a.pdf", "the whole chunk", 200.0)
    assert [tuple(b) for b in one["relative_boxes"]] == [tuple(v / s for v, s in zip(b, (200.0, 100.0) * 2)) for b in one["boxes"]] and len(one["boxes"]) == 2
    rows = {r["fact_id"]: r for r in Project("p", tables).evidence().collect()}
    assert len(rows) == len(FACTS) and rows["missing"]["boxes"] == [] and rows["no page"]["page_width"] is None
    assert rows["no anchor"]["surrounding_text"] == "at the end" and Project("q", tables).evidence().count() == 0


def test_against_a_plain_search(spark):
    r = random.Random(8)
    said = [" ".join(r.choice(("aa", "ab", "b", "aab", "c.")) for _ in range(40)) for _ in range(12)]
    words = spark.createDataFrame([w for i, t in enumerate(said) for w in laid(f"d{i}", 1, t)], WORD)
    facts = []
    for i, t in enumerate(said):
        for k in range(8):
            a = r.randrange(len(t) - 12)
            facts.append(("p", f"{i}-{k}", f"d{i}", 0, 1, t[a : a + r.randrange(1, 12)], ""))
    got = {x["fact_id"]: [tuple(b) for b in x["boxes"]] for x in evidence.boxes(spark.createDataFrame(facts, FACT), words).collect()}
    want = {}
    for _, key, d, _, _, span, _ in facts:
        text, span, found, at = said[int(d[1:])], " ".join(span.split()), [], 0
        laid_words = laid(d, 1, text)
        while span and (at := text.find(span, at)) >= 0:
            begin, lines = 0, {}
            for w in laid_words:
                if begin < at + len(span) and begin + len(w[4]) > at:
                    lines.setdefault(w[3], []).append(w)
                begin += len(w[4]) + 1
            found += [(min(w[5] for w in ws), min(w[6] for w in ws), max(w[7] for w in ws), max(w[8] for w in ws)) for ws in lines.values()]
            at += len(span)
        if found:
            want[key] = found
    assert got == want
