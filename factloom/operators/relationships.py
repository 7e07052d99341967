"""Relationships: edges between facts, once for each unordered pair."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.schemas import RELATIONS

DISPUTES = ("contradicts", "reconciled_by_context")
AGREED_CONFIDENCE = 0.95


def ordered(pairs: DataFrame, a: str = "fact", b: str = "other") -> DataFrame:
    """pairs with fact_id_a < fact_id_b in place of a and b."""
    return pairs.withColumns({"fact_id_a": F.least(a, b), "fact_id_b": F.greatest(a, b)}).drop(a, b)


def new_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordered pairs, once each, that have no edge yet."""
    keys = ["fact_id_a", "fact_id_b"]
    return pairs.dropDuplicates(keys).join(edges.select(*keys), keys, "left_anti")


def upsert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges after new ones; of a pair the new edge stays, and of several new ones the latest."""
    latest = F.row_number().over(W.partitionBy("fact_id_a", "fact_id_b").orderBy(F.desc("_new"), F.desc("created_at")))
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n", "_new")


def listed(edges: DataFrame, *, kind: str | None = None, least: float | None = None, fact: str | None = None) -> DataFrame:
    """edges by falling confidence, of a type, with a least confidence, at a fact."""
    if kind is not None and kind not in RELATIONS:
        raise ValueError(f"no such type: {kind}")
    out = edges
    if kind is not None:
        out = out.where(F.col("type") == kind)
    if least is not None:
        out = out.where(F.col("confidence") >= least)
    if fact is not None:
        out = out.where((F.col("fact_id_a") == fact) | (F.col("fact_id_b") == fact))
    return out.orderBy(F.desc("confidence"), "fact_id_a", "fact_id_b")


def at_facts(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """edges with an end among facts, once each."""
    ids = facts.select("fact_id")
    a = edges.join(ids.withColumnRenamed("fact_id", "fact_id_a"), "fact_id_a", "left_semi")
    b = edges.join(ids.withColumnRenamed("fact_id", "fact_id_b"), "fact_id_b", "left_semi")
    return a.unionByName(b).dropDuplicates(["fact_id_a", "fact_id_b"])


def disputes(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Disputed edges with both ends among facts."""
    ids = facts.select("fact_id")
    return (
        edges.where(F.col("type").isin(*DISPUTES))
        .join(ids.withColumnRenamed("fact_id", "fact_id_a"), "fact_id_a", "left_semi")
        .join(ids.withColumnRenamed("fact_id", "fact_id_b"), "fact_id_b", "left_semi")
    )


def detail(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """edges with both facts as structs; an edge with an end that is missing is left out."""
    of = lambda end: facts.select(F.col("fact_id").alias(f"fact_id_{end}"), F.struct(*facts.columns).alias(f"fact_{end}"))
    return edges.join(of("a"), "fact_id_a").join(of("b"), "fact_id_b")


def from_checks(checks: DataFrame) -> DataFrame:
    """Edges from decided pairs: what corroborates is one, with a fixed confidence."""
    return checks.where("outcome = 'corroborates'").select(
        "fact_id_a", "fact_id_b", F.lit("corroborates").alias("type"), F.col("reason").alias("explanation"), F.lit(AGREED_CONFIDENCE).alias("confidence")
    )
