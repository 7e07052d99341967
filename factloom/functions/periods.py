"""Periods: from a label to the span of days it names, and how two spans lie to each other."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.functions.text import strip

#: Fixed value: the month in which a fiscal year begins if a document does not say.
FY_START = 4
#: Month names and their short forms.
MONTH_NAMES = "january february march april may june july august september october november december".split()
MONTHS = {m: i for i, m in enumerate(MONTH_NAMES, 1)} | {m[:3]: i for i, m in enumerate(MONTH_NAMES, 1)}
#: Number words of stub periods.
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
#: The label grammar.
ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
MONTH_DAY = r"(?i)\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
DAY_MONTH = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?,?\s+(\d{4})\b"
PREFIX = r"(?:fy|f\.y\.|fiscal(?:\s+year)?|financial\s+year|cy|calendar\s+year)"
SPANS = (
    rf"(?i)\bfrom\s+({PREFIX}\s*)?(\d{{2,4}})\s*(?:to|through|thru|till|until|[-–—])\s*({PREFIX}\s*)?(\d{{2,4}})\b",
    rf"(?i)\bbetween\s+({PREFIX}\s*)?(\d{{2,4}})\s*and\s+({PREFIX}\s*)?(\d{{2,4}})\b",
    rf"(?i)\b({PREFIX})\s*(\d{{2,4}})\s*(?:to|through|thru|till|until|and|[-–—])\s*({PREFIX})\s*(\d{{2,4}})\b",
)
FISCAL = r"(?i)\b(?:fy|f\.y\.|fiscal(?:\s+year)?|financial\s+year)\s*(\d{2,4})(?:\s*[-/–]\s*(\d{2,4}))?\b"
BARE_SPAN = r"\b(\d{4})\s*[-/–]\s*(\d{2,4})\b"
QUARTER = r"(?i)\b(?:q\s*([1-4])|([1-4])\s*q)\b"
HALF = r"(?i)\b(?:h\s*([12])|([12])\s*h)\b"
CALENDAR = r"(?i)\b(?:cy|calendar\s+year)\s*(\d{4})\b"
BARE_YEAR = r"^\s*(\d{4})\s*$"
STUB = rf"(?i)\b(?:(\d{{1,2}}|{'|'.join(NUMBERS)})[\s-]*months?|(quarter)|(half[\s-]?year)|(year))\s+(?:ended|ending)\b"


def _group(text: Column, pattern: str, i: int) -> Column:
    """A group, null if it took no part."""
    got = F.regexp_extract(text, pattern, i)
    return F.when(got != "", got)


def _year(digits: Column) -> Column:
    n = digits.cast("int")
    return F.when(n >= 1000, n).when(n < 80, 2000 + n).otherwise(1900 + n)


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date, null if there is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _fiscal(end_year: Column, month: int) -> tuple[Column, Column]:
    if month == 1:
        return F.make_date(end_year, F.lit(1), F.lit(1)), F.make_date(end_year, F.lit(12), F.lit(31))
    return F.make_date(end_year - 1, F.lit(month), F.lit(1)), F.last_day(F.make_date(end_year, F.lit(month - 1), F.lit(1)))


def period(raw_label: Column, fy_start_month: int | None = None) -> Column:
    """A struct: raw_label, kind, start_date, end_date, fy_start_month, convention_assumed.

    A date comes first, then two years joined by a word, a fiscal year (with a quarter or a half),
    a calendar year, and a year alone. A date that the calendar does not have is unknown.
    """
    assumed, month = F.lit(fy_start_month is None), fy_start_month or FY_START
    return let(strip(F.coalesce(raw_label, F.lit(""))), lambda label: let(_parts(label), lambda g: let(_dates(g, month), lambda x: _resolved(label, g, x, month, assumed))))


def _parts(label: Column) -> Column:
    """What the grammar finds in a label, as texts."""
    lower = F.lower(label)
    month_first = _group(label, MONTH_DAY, 0).isNotNull()
    either = lambda i, j: F.when(month_first, _group(label, MONTH_DAY, i)).otherwise(_group(label, DAY_MONTH, j))
    fiscal = _group(label, FISCAL, 0).isNotNull()

    def span(i: int) -> Column:
        """Group i of the first of SPANS that matches."""
        out = F.lit(None).cast("string")
        for pattern in reversed(SPANS):
            out = F.when(_group(label, pattern, 0).isNotNull(), _group(label, pattern, i)).otherwise(out)
        return out

    ended = F.lit(False)
    for phrase in ("year ended", "year ending", "fy ended", "for the year"):
        ended = ended | F.contains(lower, F.lit(phrase))
    number = _group(lower, STUB, 1)
    words = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in NUMBERS.items()))
    months = (
        F.when(_group(lower, STUB, 2).isNotNull(), 3)
        .when(_group(lower, STUB, 3).isNotNull(), 6)
        .when(_group(lower, STUB, 4).isNotNull(), 12)
        .otherwise(F.coalesce(F.try_element_at(words, number), number.try_cast("int")))
    )
    prefix = lambda i: F.coalesce(F.lower(strip(span(i))).startswith("f"), F.lit(False))
    found = {
        "y": _group(label, ISO, 1), "m": _group(label, ISO, 2), "d": _group(label, ISO, 3),
        "name": F.lower(either(1, 2)), "day": either(2, 1), "year": either(3, 3),
        "from": span(2), "to": span(4), "fiscal_span": prefix(1) | prefix(3),
        "y1": F.when(fiscal, _group(label, FISCAL, 1)).otherwise(_group(label, BARE_SPAN, 1)), "y2": F.when(fiscal, _group(label, FISCAL, 2)).otherwise(_group(label, BARE_SPAN, 2)),
        "quarter": F.coalesce(_group(label, QUARTER, 1), _group(label, QUARTER, 2)).cast("int"), "half": F.coalesce(_group(label, HALF, 1), _group(label, HALF, 2)).cast("int"),
        "cy": _group(label, CALENDAR, 1).cast("int"), "bare": _group(label, BARE_YEAR, 1).cast("int"), "ended": ended, "months": months,
    }
    return F.struct(*[c.alias(n) for n, c in found.items()])


def _dates(g: Column, month: int) -> Column:
    """Days and years of the parts."""
    month_of = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MONTHS.items()))
    named = F.try_element_at(month_of, g["name"])
    a, b = _year(g["from"]), _year(g["to"])
    y1 = _year(g["y1"])
    start, end = _fiscal(F.greatest(y1, F.coalesce(_year(g["y2"]), y1)), month)
    found = {
        "is_day": g["y"].isNotNull() | named.isNotNull(), "day": F.when(g["y"].isNotNull(), _day(g["y"], g["m"], g["d"])).otherwise(_day(g["year"], named, g["day"])),
        "first": F.least(a, b), "last": F.greatest(a, b), "start": start, "end": end, "months": F.when(g["months"].between(1, 24), g["months"]),
    }
    return F.struct(*[c.alias(n) for n, c in found.items()])


def _resolved(label: Column, g: Column, x: Column, month: int, assumed: Column) -> Column:
    """The period of the parts, by the first rule that holds."""

    def result(kind, start, end, fy=F.lit(None), flag=F.lit(False)) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            label.alias("raw_label"), kind.alias("kind"), start.cast("date").alias("start_date"), end.cast("date").alias("end_date"),
            fy.cast("int").alias("fy_start_month"), flag.alias("convention_assumed"),
        )

    unknown = result("unknown", F.lit(None), F.lit(None))
    of_year = lambda y: (F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))
    day, months, start, end, fy = x["day"], x["months"], x["start"], x["end"], F.lit(month)
    stub = F.when(months == 3, "quarter").when(months == 6, "half").when(months == 12, "fiscal_year").otherwise("partial_year")
    q_start = F.add_months(start, 3 * (g["quarter"] - 1))
    joined, is_year = x["first"] != x["last"], g["y1"].isNotNull()
    return (
        F.when((label == "") | (x["is_day"] & day.isNull()), unknown)
        .when(x["is_day"] & g["ended"] & (F.month(day) == (month - 1 or 12)), result("fiscal_year", *_fiscal(F.year(day), month), fy, assumed))
        .when(x["is_day"] & months.isNotNull(), result(stub, F.add_months(F.trunc(day, "month"), 1 - months), day, F.when(months == 12, fy), assumed))
        .when(x["is_day"], result("date", day, day))
        .when(joined & g["fiscal_span"], result("multi_year", _fiscal(x["first"], month)[0], _fiscal(x["last"], month)[1], fy, assumed))
        .when(joined, result("multi_year", of_year(x["first"])[0], of_year(x["last"])[1], F.lit(1)))
        .when(is_year & g["quarter"].isNotNull(), result("quarter", q_start, F.last_day(F.add_months(q_start, 2)), fy, assumed))
        .when(
            is_year & g["half"].isNotNull(),
            result("half", F.add_months(start, 6 * (g["half"] - 1)), F.when(g["half"] == 1, F.last_day(F.add_months(start, 5))).otherwise(end), fy, assumed),
        )
        .when(is_year, result("fiscal_year", start, end, fy, assumed))
        .when(g["cy"].isNotNull(), result("calendar_year", *of_year(g["cy"]), F.lit(1)))
        .when(g["bare"].isNotNull(), result("calendar_year", *of_year(g["bare"]), F.lit(1), F.lit(True)))
        .otherwise(unknown)
    )


def relation(a: Column, b: Column) -> Column:
    """equal, disjoint, a_contains_b, b_contains_a, overlap or unknown, of two period structs."""
    a0, a1, b0, b1 = a["start_date"], a["end_date"], b["start_date"], b["end_date"]
    return (
        F.when(a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull(), "unknown")
        .when((a0 == b0) & (a1 == b1), "equal")
        .when((a1 < b0) | (b1 < a0), "disjoint")
        .when((a0 <= b0) & (a1 >= b1), "a_contains_b")
        .when((b0 <= a0) & (b1 >= a1), "b_contains_a")
        .otherwise("overlap")
    )
