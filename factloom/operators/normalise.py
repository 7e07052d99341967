"""Normalising by dictionary: each distinct label or unit once, then joined back to the facts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.comparators import value_interval
from factloom.functions.periods import period
from factloom.functions.units import unit_info
from factloom.functions.values import COMPARATORS, normalise_value
from factloom.sources.shared import durable


#: Up to so many distinct keys are broadcast, so that the rows that have them don't move.
MOST_BROADCAST = 100_000


def by_dictionary(df: DataFrame, key: Column, fn: Callable[[Column], Column], out: str) -> DataFrame:
    """df with out, which is fn of the key, computed once for each distinct key."""
    keyed = df.withColumn("_key", key)
    known = keyed.select(F.col("_key").alias("_known")).distinct().withColumn(out, fn(F.col("_known")))
    if not df.isStreaming:
        known = durable(known)
        known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    return keyed.join(known, F.col("_key").eqNullSafe(F.col("_known"))).drop("_key", "_known")


def with_period(df: DataFrame, label: Column, out: str) -> DataFrame:
    return by_dictionary(df, label, period, out)


def with_value(df: DataFrame, kind: Column, value: str, out: str, written: Column | None = None) -> DataFrame:
    """df with out, the comparable value; units by dictionary, then the interval, then the value, each computed once. written as in value_interval."""
    comparator = F.col(f"{value}.comparator")
    known = by_dictionary(df, F.col(f"{value}.unit"), unit_info, "_unit")
    raw = value_interval(F.when(comparator.isin(*COMPARATORS), comparator), F.col(f"{value}.number").cast("double"), F.col(f"{value}.number_high").cast("double"), written)
    staged = known.withColumn("_raw", raw)
    return staged.withColumn(out, normalise_value(kind, F.col(value), F.col("_unit"), F.col("_raw"))).drop("_unit", "_raw")
