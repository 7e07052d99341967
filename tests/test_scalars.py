"""Scalar functions against golden rows."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import comparators, numbers, periods, qualifiers, text, units, values

VALUE = "struct<comparator:string,number:double,number_high:double,unit:string,state:string,text:string>"


def column(spark, rows, schema, expr):
    """expr of each row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


QUANTITIES = [
    (127.0, "INR Crore", 1.27e9, "currency", "INR"), (1266.41, "INR million", 1.26641e9, "currency", "INR"), (5.0, "Rs. Lakh", 5e5, "currency", "INR"),
    (3.2, "INR lakh crore", 3.2e12, "currency", "INR"), (45.0, "thousand crore", 4.5e11, "count", None), (2.8, "billion", 2.8e9, "count", None),
    (740.0, "Mn", 7.4e8, "count", None), (33.0, "k", 33000, "count", None), (6.5, "%", 0.065, "percent", None), (50.0, "bps", 0.005, "percent", None),
    (1.4, "Mn Tonnes", 1.4e9, "mass", None), (500.0, "km", 5e5, "length", None), (31.0, "days", 31, "duration", None), (12.0, "trucks", 12, "count", None),
    *[(1000.0, u, 92.90304, "area", None) for u in ("sq ft", "square feet", "sq. ft.", "sqft", "ft2", "ft²", "Square Foot")],
    (2.5, "million sq ft", 232257.6, "area", None), (1.0, "sq m", 1, "area", None), (1.0, "m2", 1, "area", None), (1.0, "sq km", 1e6, "area", None),
    (1.0, "ha", 1e4, "area", None), (1.0, "acre", 4046.8564224, "area", None), (1.0, "sq mi", 2589988.110336, "area", None),
    (1000.0, "last-mile shipments", 1000, "count", None), (1000.0, "mid-mile trucks", 1000, "count", None), (1000.0, "last-mile delivery %", 10, "percent", None),
    (1000.0, "last-mile", 1000, "unknown", None), (1000.0, "air miles", 1000, "unknown", None), (1.0, "nautical mile", 1609.344, "length", None),
    (1266.41, "₹1,266.41 million", 1.26641e9, "currency", "INR"), (42.0, None, 42, "unknown", None), (3.0, "$/kg", 3, "currency", "USD"), (2.0, "per cent", 0.02, "percent", None), (2.0, "basis points", 2e-4, "percent", None),
]


def test_quantities(spark):
    got = column(spark, [q[:2] for q in QUANTITIES], "n double, u string", units.quantity(F.col("n"), F.col("u")))
    for q, g in zip(QUANTITIES, got):
        assert (g["dimension"], g["currency"]) == q[3:], q
        assert math.isclose(g["magnitude"], q[2], rel_tol=1e-9), q
    assert got[3]["scale_word"] == "lakh crore" and got[0]["base_unit"] == "INR" and got[4]["base_unit"] == "unit"


D = date
PERIODS = [
    *[(x, "fiscal_year", D(2023, 4, 1), D(2024, 3, 31)) for x in ("FY24", "FY2024", "FY 2023-24", "FY2023-2024", "fiscal year 2024", "Financial Year 2023–24")],
    ("2025-26", "fiscal_year", D(2025, 4, 1), D(2026, 3, 31)), ("Q4 FY24", "quarter", D(2024, 1, 1), D(2024, 3, 31)), ("Q1 FY24", "quarter", D(2023, 4, 1), D(2023, 6, 30)),
    ("H1 FY24", "half", D(2023, 4, 1), D(2023, 9, 30)), ("2H FY24", "half", D(2023, 10, 1), D(2024, 3, 31)), ("CY2025", "calendar_year", D(2025, 1, 1), D(2025, 12, 31)), ("2024", "calendar_year", D(2024, 1, 1), D(2024, 12, 31)),
    *[(x, "date", D(2024, 3, 31), D(2024, 3, 31)) for x in ("March 31, 2024", "31 March 2024", "2024-03-31", "Mar. 31st, 2024")],
    *[(x, "multi_year", D(2018, 4, 1), D(2024, 3, 31)) for x in ("growth from FY2019 to FY2024", "CAGR between FY19 and FY24", "FY2019 to FY2024", "FY2019-FY2024", "revenue FY24 to FY19")],
    *[(x, "multi_year", D(2019, 1, 1), D(2024, 12, 31)) for x in ("from 2019 through 2024", "between CY2019 and CY2024")],
    ("for the year ended March 31, 2024", "fiscal_year", D(2023, 4, 1), D(2024, 3, 31)), ("for the nine months ended December 31, 2024", "partial_year", D(2024, 4, 1), D(2024, 12, 31)),
    ("9 months ended 31 December 2024", "partial_year", D(2024, 4, 1), D(2024, 12, 31)), ("quarter ended December 31, 2024", "quarter", D(2024, 10, 1), D(2024, 12, 31)),
    ("six months ended 30 September 2024", "half", D(2024, 4, 1), D(2024, 9, 30)), ("twelve months ended March 31, 2025", "fiscal_year", D(2024, 4, 1), D(2025, 3, 31)),
    ("year ended December 31, 2024", "fiscal_year", D(2024, 1, 1), D(2024, 12, 31)), ("as at December 31, 2024", "date", D(2024, 12, 31), D(2024, 12, 31)), ("the reporting period", "unknown", None, None),
    ("half year ended March 31, 2024", "fiscal_year", D(2023, 4, 1), D(2024, 3, 31)), ("from 2023-24", "multi_year", D(2023, 1, 1), D(2024, 12, 31)), ("FY2019-2024", "fiscal_year", D(2023, 4, 1), D(2024, 3, 31)), ("2024-13-40", "unknown", None, None), (None, "unknown", None, None),
]


def test_periods(spark):
    got = column(spark, [(p[0],) for p in PERIODS], "l string", periods.period(F.col("l")))
    for p, g in zip(PERIODS, got):
        assert (g["kind"], g["start_date"], g["end_date"]) == p[1:], p
    (one,) = column(spark, [("FY2024",)], "l string", periods.period(F.col("l"), 1))
    assert (one["start_date"], one["end_date"], one["convention_assumed"]) == (D(2024, 1, 1), D(2024, 12, 31), False)


def test_relations(spark):
    rows = [
        ("FY24", "FY 2023-24", "equal"), ("FY24", "for the year ended March 31, 2024", "equal"), ("FY24", "Q4 FY24", "a_contains_b"), ("Q4 FY24", "FY24", "b_contains_a"), ("FY24", "FY25", "disjoint"),
        ("H1 FY24", "Q2 FY24", "a_contains_b"), ("H1 FY24", "H2 FY24", "disjoint"), ("the period", "FY24", "unknown"), ("from FY2019 to FY2024", "FY22", "a_contains_b"), ("from FY2019 to FY2024", "FY2030", "disjoint"), ("nine months ended December 31, 2024", "Q2 FY25", "a_contains_b"), ("FY24", "CY2024", "overlap"),
    ]
    assert column(spark, [r[:2] for r in rows], "a string, b string", periods.relation(periods.period(F.col("a")), periods.period(F.col("b")))) == [r[2] for r in rows]


def python_half_step(n):
    if n == 0:
        return 0.5
    s = repr(abs(n))
    if "e" in s:
        return 0.5 * 10 ** (math.floor(math.log10(abs(n))) - 5)
    whole, _, frac = s.partition(".")
    frac = frac.rstrip("0")
    return 0.5 * 10 ** -len(frac) if frac else 0.5 * 10 ** (len(whole) - len(whole.rstrip("0")))


def test_half_steps(spark):
    given = [0.0, 6.5, 33278.0, 8100.0, -8100.0, 0.001, 0.0001, 0.00012, 1e7, 12345678.9, 1.5e7, 123456789.25, 1e15, 1e16, 2.5e20, 3e-5, 99999999.0, 100.25, 0.1 + 0.2]
    for n, g in zip(given, column(spark, [(n,) for n in given], "n double", comparators.half_step(F.col("n")))):
        assert g == pytest.approx(python_half_step(n), rel=1e-12), n


def test_intervals(spark):
    rows = [("gt", 33250.0, None), ("eq", 6.5, None), ("eq", 6.6, None), ("approx", 100.0, None), ("range", 7.0, 5.0), ("eq", 33278.0, None), (None, 8100.0, None), ("eq", None, None), ("lte", 5.0, None), ("gte", 5.0, None)]
    got = column(spark, rows, "c string, n double, h double", comparators.value_interval(F.col("c"), F.col("n"), F.col("h")))
    assert (got[0]["low"], got[0]["high"], got[0]["low_closed"]) == (33250, math.inf, False)
    assert (got[1]["low"], got[1]["high"], got[1]["high_closed"]) == (6.45, 6.55, False)
    assert got[7] is None and (got[3]["low"], got[3]["high"]) == (50, 150) and (got[4]["low"], got[4]["high"]) == (4.5, 7.5) and (got[6]["low"], got[6]["high"]) == (8050, 8150)
    pairs = [(1, 2, False), (1, 1, True), (8, 9, True), (0, 5, True), (2, 3, False)]
    schema = "struct<low:double,high:double,low_closed:boolean,high_closed:boolean>"
    out = column(spark, [(got[a], got[b]) for a, b, _ in pairs], f"a {schema}, b {schema}", comparators.overlaps(F.col("a"), F.col("b")))
    assert out == [p[2] for p in pairs]
    assert column(spark, [(got[4], 6.9), (got[4], 7.5), (got[5], 33277.6)], f"v {schema}, p double", comparators.contains_point(F.col("v"), F.col("p"))) == [True, False, True]


def test_phrases(spark):
    rows = [("over 5", "gt"), ("more than 5", "gt"), ("at least 5", "gte"), ("up to 5", "lte"), ("no more than 5", "lte"), ("fewer than 5", "lt"), ("approximately 5", "approx"), ("~5", "approx"), ("between 5 and 6", "range"), ("plain 5", None), ("5+", "gt"), ("5-6", "range")]
    assert column(spark, [r[:1] for r in rows], "t string", comparators.phrase_comparator(F.col("t"))) == [r[1] for r in rows]


def test_assumptions(spark):
    rows = [
        ("quantitative", True, "eq", None, []), *[("quantitative", True, "eq", p, ["fy_convention_assumed"]) for p in ("FY24", "Q3 FY24", "H1 FY24")],
        *[("quantitative", True, "eq", p, []) for p in ("2024", "calendar year 2024", "March 31, 2024", " ")], ("quantitative", False, "eq", "", ["entity_inferred"]),
        ("quantitative", True, None, "", ["comparator_unspecified"]), ("status", True, None, "", []), ("quantitative", False, None, "FY24", ["entity_inferred", "comparator_unspecified", "fy_convention_assumed"]),
    ]
    flags = qualifiers.assumptions(F.col("k"), F.col("r"), F.col("c"), periods.period(F.col("p")))
    assert column(spark, [r[:4] for r in rows], "k string, r boolean, c string, p string", flags) == [r[4] for r in rows]
    pen = column(spark, [(0.9, ["a"]), (0.9, ["a"] * 3), (0.1, ["a"] * 2), (0.03, [])], "c double, f array<string>", qualifiers.penalised(F.col("c"), F.col("f")))
    assert pen == pytest.approx([0.8, 0.6, 0.05, 0.03])


def test_qualifiers(spark):
    rows = [
        ({"Basis ": "Consol"}, {"measurement_basis": "consolidated"}, []), ({"basis": "consolidated"}, {"basis": "standalone"}, ["basis"]), ({"audited": "yes", "scope": "a"}, {"audit_status": "No", "region": "b"}, ["audited", "scope"]),
        ({"basis": " "}, {"basis": "x"}, []), ({"basis": None}, {"basis": "x"}, ["basis"]), (None, {"basis": "x"}, []), ({"estimate_vs_actual": "guidance"}, {"forecast_vs_actual": "Projected"}, []),
    ]
    diff = qualifiers.differing(qualifiers.significant(F.col("a")), qualifiers.significant(F.col("b")))
    assert column(spark, [r[:2] for r in rows], "a map<string,string>, b map<string,string>", diff) == [r[2] for r in rows]


def test_figures(spark):
    rows = [("(1,234)", -1234), ("(1,234.50)", -1234.5), ("₹(1,234)", -1234), ("Rs (1,234) cr", -1234), ("(1,234 crore)", -1234), ("(0)", 0), ("(4.5%)", -4.5), ("1,234", 1234), ("-1,234", -1234), ("(-1,234)", -1234), ("revenue rose 5%", 5), ("EBITDA of 127 (see note 4)", 127), ("net loss narrowed", None), ("−12", -12)]
    assert column(spark, [r[:1] for r in rows], "t string", numbers.parse_figure(F.col("t"))) == [r[1] for r in rows]


def test_values(spark):
    rows = [("quantitative", ("gt", 5.0, None, "INR Crore", None, None)), ("quantitative", ("eq", 0.0, None, "crore", None, None)), ("status", (None, None, None, None, " Profitable  Now", None)), ("qualitative", (None, None, None, None, None, " x ")), ("quantitative", (None, None, None, "%", None, None))]
    got = column(spark, rows, f"k string, v {VALUE}", values.normalise_value(F.col("k"), F.col("v")))
    assert (got[0]["interval"]["low"], got[0]["interval"]["high"], got[0]["currency"]) == (5e7, math.inf, "INR")
    assert (got[1]["interval"]["low"], got[1]["interval"]["high"]) == (-0.5, 0.5)
    assert got[2]["state"] == "profitable now" and got[3]["text"] == "x" and not got[4]["comparable"]
    shown = [(None, 127.0, "crore", "~127 crore"), ("eq", 127.0, "crore", "127 crore"), ("gte", 1.5, None, "gte 1.5")]
    assert column(spark, [(c, n, None, u) for c, n, u, _ in shown], "c string, n double, h double, u string", values.show_quantity(F.col("c"), F.col("n"), F.col("h"), F.col("u"))) == [s[3] for s in shown]


def test_grounding(spark):
    long = "Revenue grew to 127 crore in the year. The com-\npany’s “margin” – 6.5% – held."
    rows = [("Revenue grew to 127 crore", long, None), ("revenue  grew\nto 127 crore", long, None), ("The company's \"margin\" - 6.5%", long, None), ("not there at all", long, "not in source"), ("127", long, "too short"), ("rate 5", "rate 5 " * 6, "too generic"), ("rate 5", "rate 5 " * 4, None), (None, long, "too short")]
    got = column(spark, [r[:2] for r in rows], "e string, s string", text.grounding(F.col("e"), F.col("s")))
    assert [(g["passed"], g["reason"]) for g in got] == [(r[2] is None, r[2]) for r in rows]
    assert column(spark, [("a",), ("x" * 9,), ("",)], "t string", text.estimate_tokens(F.col("t"))) == [1, 2, 1]
    assert column(spark, [("short",), ("w " * 500 + "end",)], "t string", text.tail(F.col("t"), 4)) == ["short", "w w w w w w end"]
