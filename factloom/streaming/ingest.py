"""Streams: windows of log results, and documents that arrive, each content once.

A stream keeps its state and results in the shared folder.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import shared_folder


def state_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder (a file or a folder of files) as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def log_windows(events: DataFrame, *, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Results per window and event_type; events later than the watermark are let go by append-mode sinks."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return (
        timed.groupBy(F.window("at", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("n_positive"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "n_positive")
    )


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream has now, as a table of Parquet files; executors write it, the driver holds none of it.

    In complete mode each batch holds all results, so the last one is read; else all are.
    """
    spark = stream.sparkSession
    at, done = state_folder(spark), []

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/batch={number}")
        done.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", state_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(*[f"{at}/batch={n}" for n in (done[-1:] if mode == "complete" else done)])


def take_new(documents: DataFrame, store: str) -> None:
    """Appends to the store (Parquet) each arriving document whose content it does not hold.

    Of equal contents in one batch the smallest id is taken. A batch that runs again after a
    failure writes its own folder anew, so nothing is taken twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        hashed = df.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
        new = hashed.join(first, ["content_hash", "doc_id"], "left_semi").dropDuplicates(["content_hash"])
        if number:
            known = spark.read.parquet(store).where(F.col("batch") < number).select("content_hash")
            new = new.join(known, "content_hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    query = documents.writeStream.foreachBatch(batch).option("checkpointLocation", state_folder(documents.sparkSession)).trigger(availableNow=True).start()
    query.awaitTermination()
