"""Units: from a unit's text to a dimension, a currency and a magnitude on the dimension's base unit."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

#: Scale words and what they multiply by.
SCALES = {
    "hundred": 1e2, "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lac": 1e5, "lakhs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mln": 1e6, "m": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "bln": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "trn": 1e12,
}
#: Tokens of currencies.
CURRENCIES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "rupee": "INR",
    "$": "USD", "us$": "USD", "usd": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR", "euros": "EUR",
    "£": "GBP", "gbp": "GBP", "¥": "JPY", "jpy": "JPY",
}
#: Percent tokens and their factors.
PERCENTS = {"%": 1e-2, "percent": 1e-2, "pct": 1e-2, "percentage": 1e-2, "bps": 1e-4}
#: Physical units by dimension, with factors to the base unit.
PHYSICAL = {
    "mass": {
        "kg": 1.0, "kgs": 1.0, "kilogram": 1.0, "kilograms": 1.0, "g": 1e-3, "gram": 1e-3, "grams": 1e-3, "mg": 1e-6,
        "t": 1e3, "ton": 1e3, "tons": 1e3, "tonne": 1e3, "tonnes": 1e3, "mt": 1e3,
        "lb": 0.45359237, "lbs": 0.45359237, "pound": 0.45359237, "pounds": 0.45359237,
    },
    "length": {
        "metre": 1.0, "meter": 1.0, "metres": 1.0, "meters": 1.0, "km": 1e3, "kilometre": 1e3, "kilometer": 1e3,
        "cm": 1e-2, "mm": 1e-3, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "ft": 0.3048,
    },
    "area": {
        "sqm": 1.0, "sqcm": 1e-4, "sqkm": 1e6, "sqft": 0.09290304, "sqmi": 2589988.110336, "acre": 4046.8564224, "hectare": 1e4,
    },
    "duration": {
        "day": 1.0, "days": 1.0, "week": 7.0, "weeks": 7.0, "month": 30.0, "months": 30.0,
        "year": 365.0, "years": 365.0, "yr": 365.0, "yrs": 365.0, "hour": 1 / 24, "hours": 1 / 24, "hrs": 1 / 24,
    },
}
BASES = {"mass": "kg", "length": "m", "area": "m2", "duration": "day", "percent": "fraction", "count": "unit"}
#: Nouns that are counted.
COUNTED = (
    "shipments parcels packages consignments deliveries pickups boxes cartons pallets containers units items pieces orders "
    "transactions trips routes lanes employees headcount staff personnel people passengers customers clients subscribers users "
    "accounts members stores outlets branches hubs warehouses facilities sites locations centres centers plants factories "
    "franchises dealers distributors partners cities towns districts countries markets trucks vehicles count nos no. x"
).split()
#: Spellings of areas, the longer lengths before the metre.
AREAS = (
    ("kilomet(?:re|er)s?|kms?", "sqkm"),
    ("centimet(?:re|er)s?|cms?", "sqcm"),
    ("miles?|mi", "sqmi"),
    ("feet|foot|ft", "sqft"),
    ("met(?:re|er)s?|m", "sqm"),
)
#: Terms that hold the word mile and are no distance.
NO_DISTANCE = (
    r"(?i)\b(?:(?:last|first|middle|mid|final)[\s-]*miles?|(?:country|green|extra|golden)[\s-]+miles?"
    r"|(?:air|reward|loyalty|bonus)[\s-]+miles?|frequent[\s-]+flyer[\s-]+miles?)\b"
)
STOPWORDS = (".", "of", "the", "in", "a")


def _map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def unit_tokens(unit: Column) -> Column:
    text = F.lower(strip(F.coalesce(unit, F.lit(""))))
    text = F.replace(F.replace(text, F.lit("per cent"), F.lit("percent")), F.lit("basis points"), F.lit("bps"))
    text = F.regexp_replace(text, NO_DISTANCE, " ")
    for names, token in AREAS:
        # A superscript two is no word character to Java, so its end is told by what follows.
        text = F.regexp_replace(text, rf"\bsq(?:uare)?\.?\s*(?:{names})\b|\b(?:{names})\s*(?:2\b|²(?![\p{{L}}\p{{N}}_]))", f" {token} ")
    text = F.regexp_replace(F.regexp_replace(text, r"\bhectares?\b|\bha\b", " hectare "), r"\bacres?\b", " acre ")
    found = F.regexp_extract_all(text, F.lit(r"[a-z%₹$€£¥.]+|[0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def unit_info(unit: Column) -> Column:
    """A struct: scale, factor, dimension, currency, base_unit, scale_word, raw_unit.

    Tokens are read from left to right. The first currency wins and a physical unit behind it is a
    denominator; scale words multiply; a percent sign sets the dimension; a physical unit or a
    counted noun sets it only while it is open.
    """
    factors = _map({t: f for units in PHYSICAL.values() for t, f in units.items()})
    dims = _map({t: d for d, units in PHYSICAL.items() for t in units})
    nothing = F.lit(None).cast("string")
    start = F.struct(
        nothing.alias("currency"), nothing.alias("scale_word"), F.lit(1.0).alias("scale"), F.lit("unknown").alias("dim"), F.lit(1.0).alias("factor")
    )

    def read(acc: Column, t: Column) -> Column:
        def state(**new: Column) -> Column:
            return F.struct(*[new.get(k, acc[k]).alias(k) for k in ("currency", "scale_word", "scale", "dim", "factor")])

        money, scale, percent = F.try_element_at(_map(CURRENCIES), t), F.try_element_at(_map(SCALES), t), F.try_element_at(_map(PERCENTS), t)
        physical = F.try_element_at(factors, t)
        return (
            F.when(money.isNotNull() & acc["currency"].isNull(), state(currency=money, dim=F.lit("currency")))
            .when(scale.isNotNull(), state(scale_word=F.concat_ws(" ", acc["scale_word"], t), scale=acc["scale"] * scale))
            .when(percent.isNotNull(), state(dim=F.lit("percent"), factor=percent))
            .when(physical.isNotNull() & (acc["dim"] == "unknown"), state(dim=F.try_element_at(dims, t), factor=physical))
            .when(t.isin(*COUNTED) & (acc["dim"] == "unknown"), state(dim=F.lit("count")))
            .otherwise(acc)
        )

    def finish(acc: Column) -> Column:
        dim = F.when((acc["dim"] == "unknown") & acc["scale_word"].isNotNull(), "count").otherwise(acc["dim"])
        base = F.when(dim == "currency", F.coalesce(acc["currency"], F.lit(""))).otherwise(F.coalesce(F.try_element_at(_map(BASES), dim), F.lit("")))
        return F.struct(
            acc["scale"].alias("scale"),
            acc["factor"].alias("factor"),
            dim.alias("dimension"),
            acc["currency"].alias("currency"),
            base.alias("base_unit"),
            acc["scale_word"].alias("scale_word"),
            strip(F.coalesce(unit, F.lit(""))).alias("raw_unit"),
        )

    return F.aggregate(unit_tokens(unit), start, read, finish)


def magnitude(number: Column, info: Column) -> Column:
    """A figure on the base unit of its dimension."""
    return number * info["scale"] * info["factor"]


def quantity(number: Column, unit: Column) -> Column:
    """A struct: magnitude and the fields of unit_info."""
    info = unit_info(unit)
    fields = ("dimension", "currency", "base_unit", "scale_word", "raw_unit")
    return F.struct(magnitude(number, info).alias("magnitude"), *[info[f].alias(f) for f in fields])
