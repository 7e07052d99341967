"""Comparators: the set of values a figure stands for, as an interval; and whether two sets meet."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let

#: Phrases of comparators, in the order in which they are tried.
PHRASES = (
    ("lte", r"\bno more than\b|\bnot more than\b|\bat most\b|\bup to\b"),
    ("gte", r"\bno less than\b|\bat least\b|\bminimum of\b|\bor more\b"),
    ("gt", r"\bmore than\b|\bgreater than\b|\bover\b|\bexceed(?:s|ed|ing)?\b|\babove\b|\bnorth of\b|\+\s*$"),
    ("lt", r"\bless than\b|\bfewer than\b|\bunder\b|\bbelow\b|\bshy of\b"),
    ("approx", r"\bapprox(?:\.|imately)?\b|\babout\b|\baround\b|\broughly\b|\bnearly\b|\bcirca\b|~"),
    ("range", r"\bbetween\b|\bfrom\b.*\bto\b|\brange of\b|[-–]\s*\d"),
)
#: How wide "approximately" is, relative and at least.
APPROX_SHARE, APPROX_LEAST = 0.05, 0.5


def phrase_comparator(text: Column) -> Column:
    """The comparator that a text states in words, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PHRASES):
        out = F.when(F.rlike(text, F.lit("(?i)" + pattern)), name).otherwise(out)
    return out


def half_step(number: Column) -> Column:
    """Half of the last place that a figure is written to; zeros at the end of a whole number are not written to.

    Figures of 1e16 and over, or under 1e-4, are taken to have six places.
    """
    size = F.abs(number)
    text = size.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    fraction = F.rtrim(F.substring_index(mantissa, ".", -1), F.lit("0"))
    places = F.length(fraction) - exponent  # places behind the point of the figure written out
    zeros = F.length(whole) - F.length(F.rtrim(whole, F.lit("0")))
    power = (
        F.when((size >= 1e16) | (size < 1e-4), exponent - 5)
        .when(places > 0, -places)
        .otherwise(-places + F.when(fraction == "", zeros).otherwise(0))
    )
    return F.when(number == 0, F.lit(0.5)).otherwise(F.concat(F.lit("1e"), power.cast("string")).cast("double") * 0.5)


def _interval(low: Column, high: Column, low_closed: bool, high_closed: bool) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), F.lit(low_closed).alias("low_closed"), F.lit(high_closed).alias("high_closed"))


def value_interval(comparator: Column, number: Column, number_high: Column, written: Column | None = None) -> Column:
    """The values that a figure stands for; null without a figure.

    written is the figure in the places that it is given to, where number has noise behind these.
    """
    inf = F.lit(float("inf"))
    given = F.struct(F.coalesce(number, number_high).alias("n"), F.coalesce(number_high, number).alias("top"), (F.coalesce(number, number_high) if written is None else written).alias("written"))
    steps = lambda g: F.struct(
        g["n"].alias("n"), F.least(g["n"], g["top"]).alias("low"), F.greatest(g["n"], g["top"]).alias("high"), half_step(g["written"]).alias("half"), half_step(g["top"]).alias("top_half"),
        (g["n"] <= g["top"]).alias("rising"),
    )

    def read(x: Column) -> Column:
        n, half = x["n"], x["half"]
        wide = F.greatest(F.abs(n) * APPROX_SHARE, F.lit(APPROX_LEAST), half)
        low_half, high_half = F.when(x["rising"], half).otherwise(x["top_half"]), F.when(x["rising"], x["top_half"]).otherwise(half)
        return F.when(
            n.isNotNull(),
            F.when(comparator == "gt", _interval(n, inf, False, False))
            .when(comparator == "gte", _interval(n, inf, True, False))
            .when(comparator == "lt", _interval(-inf, n, False, False))
            .when(comparator == "lte", _interval(-inf, n, False, True))
            .when(comparator == "approx", _interval(n - wide, n + wide, True, True))
            .when(comparator == "range", _interval(x["low"] - low_half, x["high"] + high_half, True, False))
            .otherwise(_interval(n - half, n + half, True, False)),
        )

    return let(given, lambda g: let(steps(g), read))


def is_empty(i: Column) -> Column:
    return (i["low"] > i["high"]) | ((i["low"] == i["high"]) & ~(i["low_closed"] & i["high_closed"]))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two intervals share a value."""
    apart = (
        (a["high"] < b["low"])
        | (b["high"] < a["low"])
        | ((a["high"] == b["low"]) & ~(a["high_closed"] & b["low_closed"]))
        | ((b["high"] == a["low"]) & ~(b["high_closed"] & a["low_closed"]))
    )
    return ~(is_empty(a) | is_empty(b) | apart)


def contains_point(i: Column, x: Column) -> Column:
    return overlaps(i, _interval(x, x, True, True))
