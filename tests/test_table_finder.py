"""Tables drawn on pages and found again: plain, ragged, with broken cells, beside text, several on a page."""

import random

from factloom.operators import table_finder

WORD = "document_id string, page_number int, place int, line int, word string, x0 double, y0 double, x1 double, y1 double"
AT = (50.0, 200.0, 320.0, 430.0)


def draw(page, items):
    """Items are sentences or tables (lists of rows, cells with line breaks) down a page; lines are 10 high."""
    out, y, line = [], 20.0, 0

    def put(x, text):
        for w in text.split():
            out.append(("d", page, len(out), line, w, x, y, x + 5.0 * len(w), y + 10))
            x += 5.0 * len(w) + 4

    for item in items:
        if isinstance(item, str):
            put(50.0, item)
            y, line = y + 16, line + 1
            continue
        for row in item:
            cells = [(c or "").split("\n") for c in row]
            for k in range(max(map(len, cells))):
                for x, c in zip(AT, cells):
                    if k < len(c):
                        put(x, c[k])
                y, line = y + 11, line + 1
            y += 9
        y += 60
    return out


def cleaned(rows):
    wide = max(map(len, rows))
    full = [[" ".join((c or "").split()) for c in r] + [""] * (wide - len(r)) for r in rows]
    return [r for r in full if any(r)]


def test_drawn_tables(spark):
    plain = [["Part", "Qty", "Price"], ["P1", "2", "10"], ["P2 and more", "3", "12 000"]]
    ragged = [["Year", "Low", "High", "Mean"], ["2020", "1"], ["", "4", "5"], [None, "", "7", "8"], ["2021", "2", "3", "4"]]
    broken = [["Name of\nthe part", "Count"], ["a bolt of\nsteel and\nbrass", "5"], ["nut", "six or\nseven"]]
    pages = {
        1: [plain], 2: ["A sentence that runs across the page over all of its columns and on", plain, "Another sentence ends the page"], 3: [ragged], 4: [broken, "words between them", ragged],
        5: ["no table", "on this page at all"], 6: [[["only", "row"]]], 7: [[["a"], ["b"]]],
    }
    words = [w for p, items in pages.items() for w in draw(p, items)] + [("d", 8, 0, 0, " ", 1.0, 1.0, 2.0, 2.0), ("d", 8, 1, 0, "x", None, 1.0, 2.0, 2.0)]
    got = {}
    for r in table_finder.find_tables(spark.createDataFrame(words, WORD)).orderBy("page_number", "table").collect():
        got.setdefault(r["page_number"], []).append(r["rows"])
    assert got == {1: [cleaned(plain)], 2: [cleaned(plain)], 3: [cleaned(ragged)], 4: [cleaned(broken), cleaned(ragged)]}
    (one,) = table_finder.find_tables(spark.createDataFrame(draw(1, [plain]), WORD)).collect()
    assert tuple(one["bbox"]) == (50.0, 20.0, 349.0, 70.0)
    assert table_finder.find_tables(spark.createDataFrame([], WORD)).count() == 0


def test_many_tables_by_rule(spark):
    r = random.Random(3)
    want, words = {}, []
    for page in range(1, 41):
        columns = r.randint(2, 4)
        rows = [[f"h{j}" for j in range(columns)]]
        rows += [["" if r.random() < 0.2 else "\n".join(r.choice(("aa", "b c", "1,000")) for _ in range(r.choice((1, 1, 1, 2)))) for _ in range(columns)] for _ in range(r.randint(1, 8))]
        rows = [x for i, x in enumerate(rows) if i == 0 or sum(bool(c) for c in x) >= 2]
        if len(rows) > 1 and all(any(x[j] for x in rows) for j in range(columns)):
            want[page] = cleaned(rows)
            words += draw(page, ["A heading that lies over the table and more than one of its columns", rows])
    got = {x["page_number"]: x["rows"] for x in table_finder.find_tables(spark.createDataFrame(words, WORD)).collect()}
    assert got == want and len(want) > 30
