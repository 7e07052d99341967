"""Model calls as a join: requests against a table of responses, so that runs repeat exactly."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Errors that another provider may make good.
FAILOVER = ("rate_limit", "timeout", "auth", "transport")
#: Fixed value: texts that are embedded at once.
EMBEDDED_AT_ONCE = 64


def request_key(stage: str, attempt: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(stage), F.lit(str(attempt)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def answer(requests: DataFrame, primary: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """requests (request_key, ...) with text, provider and error_type; responses are (request_key, text, provider, error_type).

    A response that is missing is the error `missing`. The second provider is asked after an error
    of FAILOVER only; if it fails too, the error is `all_unavailable`.
    """
    first = primary.select("request_key", F.col("text").alias("_t1"), F.col("provider").alias("_p1"), F.col("error_type").alias("_e1"), F.lit(True).alias("_f1"))
    out = requests.join(first, "request_key", "left").withColumn("_e1", F.when(F.col("_f1").isNull(), "missing").otherwise(F.col("_e1")))
    if secondary is None:
        return out.select(*requests.columns, F.when(F.col("_e1").isNull(), F.col("_t1")).alias("text"), F.col("_p1").alias("provider"), F.col("_e1").alias("error_type"))
    other = secondary.select("request_key", F.col("text").alias("_t2"), F.col("provider").alias("_p2"), F.col("error_type").alias("_e2"), F.lit(True).alias("_f2"))
    asked = F.coalesce(F.col("_e1").isin(*FAILOVER), F.lit(False))
    good = asked & F.col("_f2").isNotNull() & F.col("_e2").isNull()
    return out.join(other, "request_key", "left").select(
        *requests.columns,
        F.when(F.col("_e1").isNull(), F.col("_t1")).when(good, F.col("_t2")).alias("text"),
        F.when(good, F.col("_p2")).otherwise(F.col("_p1")).alias("provider"),
        F.when(F.col("_e1").isNull() | good, F.lit(None)).when(asked, "all_unavailable").otherwise(F.col("_e1")).cast("string").alias("error_type"),
    )


def fact_embedding_text(entity: Column, attribute: Column, qualifiers: Column) -> Column:
    """What a fact's embedding is made from: entity | attribute | key: value ..., keys sorted."""
    pairs = F.transform(F.sort_array(F.map_entries(qualifiers)), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.concat_ws(" | ", entity, attribute, F.when(F.size(pairs) > 0, F.array_join(pairs, " | ")))


def embed_missing(facts: DataFrame, embed: Callable[[list[str]], list[list[float]]], *, size: int = EMBEDDED_AT_ONCE) -> DataFrame:
    """facts, those without an embedding with one; each distinct text is embedded once, so many texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), size):
                some = f.iloc[at : at + size]
                yield some.assign(_vector=[list(map(float, v)) for v in embed(some["_text"].tolist())])

    text = fact_embedding_text(F.col("entity"), F.col("attribute"), F.coalesce("qualifiers", F.create_map().cast("map<string,string>")))
    missing = facts.where("embedding IS NULL").withColumn("_text", text)
    vectors = missing.select("_text").distinct().mapInPandas(run, "_text string, _vector array<float>")
    filled = missing.join(vectors, "_text").withColumn("embedding", F.col("_vector").cast(dict(facts.dtypes)["embedding"])).select(*facts.columns)
    return facts.where("embedding IS NOT NULL").unionByName(filled)
