"""Figures in texts: accounting parentheses, Unicode minus signs, corrections."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an amount in accounting parentheses, with a currency before it or a scale word in it.
PARENTHESES = r"^\s*(?:(?i:rs\.?|inr|usd|eur|gbp)|[₹$€£¥])?\s*\(\s*([₹$€£¥]?\s*\d[\d,]*\.?\d*)\s*[^)\d]*\)"
FIGURE = r"-?\d[\d,]*\.?\d*"


def parse_figure(text: Column) -> Column:
    """The first figure of a text; one in accounting parentheses is negative; null if there is none."""
    plain = F.translate(text, "−", "-")
    inside = F.regexp_extract(plain, PARENTHESES, 1)
    read = lambda t: F.regexp_replace(F.regexp_extract(t, FIGURE, 0), ",", "").try_cast("double")
    return F.when(inside != "", -read(inside)).otherwise(read(plain))
