"""Running totals over groups of any size, without a group in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.sources.shared import durable


def running(df: DataFrame, by: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """df with, for each name -> column of totals, that column's sum up to and with the row, in the order of `order`, within `by`.

    Rows are dealt by range over groups and order; a task sums its own stretch, and the sums of the stretches before it in
    the group, of which there is one a task, are added. Rows that are equal in by and order have the sum of any of their orders.
    No column of by or order may be null.
    """
    parts = durable(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    stretch = parts.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stretch.select("_part", *by, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    upto = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = parts.select("*", *[F.sum(c).over(upto).alias(n) for n, c in totals.items()])
    return local.join(offsets, ["_part", *by]).select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in totals])
