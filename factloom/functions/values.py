"""Values: unit and comparator together, as one comparable value; and the lines that show a value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.comparators import is_empty, value_interval
from factloom.functions.text import norm, strip
from factloom.functions.units import magnitude, unit_info

COMPARATORS = ("eq", "approx", "gt", "gte", "lt", "lte", "range")


def normalise_value(kind: Column, value: Column, unit: Column | None = None, raw: Column | None = None) -> Column:
    """A struct: kind, dimension, currency, interval (on the base unit), state, text, scale_word, comparable.

    value is a struct of comparator, number, number_high, unit, state and text. A figure of 0 is not scaled.
    unit and raw are what unit_info and value_interval give, if they are columns already.
    """
    number, high = value["number"].cast("double"), value["number_high"].cast("double")
    base = F.coalesce(number, high)
    q = unit_info(value["unit"]) if unit is None else unit
    factor = F.when(base == 0, F.lit(1.0)).otherwise(F.try_divide(magnitude(base, q), base))
    if raw is None:
        raw = value_interval(F.when(value["comparator"].isin(*COMPARATORS), value["comparator"]), number, high)
    inf = float("inf")
    scaled = lambda x: F.when(F.abs(x) == inf, x).otherwise(x * factor)
    interval = F.when(
        raw.isNotNull(),
        F.struct(scaled(raw["low"]).alias("low"), scaled(raw["high"]).alias("high"), raw["low_closed"].alias("low_closed"), raw["high_closed"].alias("high_closed")),
    )
    counted = (kind == "quantitative") & base.isNotNull()
    return F.struct(
        kind.alias("kind"),
        F.when(counted, q["dimension"]).otherwise("unknown").alias("dimension"),
        F.when(counted, q["currency"]).alias("currency"),
        F.when(counted, interval).alias("interval"),
        F.when(kind == "status", norm(value["state"])).alias("state"),
        F.when(kind == "qualitative", strip(F.coalesce(value["text"], F.lit("")))).alias("text"),
        F.when(counted, q["scale_word"]).alias("scale_word"),
        F.coalesce(counted & ~is_empty(interval), F.lit(False)).alias("comparable"),
    )


def plain_number(n: Column) -> Column:
    """A figure as it is usually written: no exponent, no `.0`."""
    text = F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))
    return F.when(F.abs(n) < 1e16, text).otherwise(n.cast("string"))


def show_quantity(comparator: Column, number: Column, number_high: Column, unit: Column) -> Column:
    """A figure in a line: `127 crore`, `~127 crore` without a comparator, `gte 5 km`."""
    c = F.coalesce(comparator, F.lit(""))
    before = F.when(c == "eq", "").when(c == "", "~").otherwise(F.concat(c, F.lit(" ")))
    figure = F.concat_ws("-", plain_number(number), F.when(c == "range", plain_number(number_high)))
    return F.concat(before, F.concat_ws(" ", figure, F.when(strip(unit) != "", unit)))
