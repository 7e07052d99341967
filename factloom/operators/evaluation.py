"""Evaluation: what was checked, what passed, and how that ran on from document to document."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STATUSES = ("verified", "auto_corrected", "needs_review", "rejected")


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def overall(facts: DataFrame, logs: DataFrame) -> DataFrame:
    """A row per project: checks, calls, facts by status and their rates."""
    checked = logs.groupBy("project_id").agg(
        F.count_if(F.col("stage") == "grounding_check").alias("grounding_checks"),
        F.count_if((F.col("stage") == "grounding_check") & (F.col("result") == "pass")).alias("grounding_pass"),
        F.count_if(F.col("stage") == "independent_verify").alias("verify_calls"),
    )
    counted = facts.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("facts_total"), *[F.count_if(F.col("verification_status") == s).alias(f"facts_{s}") for s in STATUSES]
    )
    c = F.col
    joined = checked.join(counted, "project_id", "full").na.fill(0)
    return joined.withColumns(
        {"grounding_pass_rate": rate(c("grounding_pass"), c("grounding_checks")), **{f"{s}_rate": rate(c(f"facts_{s}"), c("facts_total")) for s in STATUSES}}
    )


def per_document(documents: DataFrame, facts: DataFrame, logs: DataFrame) -> DataFrame:
    """A row per document: facts, checks, passes and their rate; logs are dealt to documents through their facts."""
    counted = facts.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("facts_total"), *[F.count_if(F.col("verification_status") == s).alias(f"facts_{s}") for s in STATUSES]
    )
    checks = (
        logs.where("stage = 'grounding_check'")
        .join(facts.select("fact_id", "document_id"), "fact_id")
        .groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("grounding_checks"), F.count_if(F.col("result") == "pass").alias("grounding_pass"), F.count_if(F.col("result") == "fail").alias("dropped_for_grounding"))
    )
    numbers = [c for c in (*counted.columns, *checks.columns) if c != "document_id"]
    joined = documents.join(counted, "document_id", "left").join(checks, "document_id", "left").na.fill(0, numbers)
    return joined.withColumn("grounding_pass_rate", rate(F.col("grounding_pass"), F.col("grounding_checks")))


def timeline(per_doc: DataFrame) -> DataFrame:
    """Running facts and rates over a project's documents in the order of created_at, then id."""
    upto = W.partitionBy("project_id").orderBy("created_at", "document_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = lambda c: F.sum(c).over(upto)
    return per_doc.select(
        "project_id",
        F.count(F.lit(1)).over(upto).alias("index"),
        "document_id",
        total("facts_total").alias("cumulative_facts"),
        rate(total("grounding_pass"), total("grounding_checks")).alias("grounding_pass_rate"),
        rate(total("facts_verified"), total("facts_total")).alias("verified_rate"),
        rate(total("facts_needs_review"), total("facts_total")).alias("needs_review_rate"),
    )


def survivorship(per_doc: DataFrame) -> DataFrame:
    """A row per project: candidates proposed, kept and dropped, and the share that passed.

    A document without recorded counts stands with its checks.
    """
    s = lambda f: F.coalesce(F.col(f"extraction_stats.{f}"), F.lit(0))
    dropped = s("dropped_invalid") + s("dropped_no_column_context")
    checks = F.col("grounding_checks")
    out = per_doc.groupBy("project_id").agg(
        F.sum(F.when(s("candidates_returned") != 0, s("candidates_returned")).otherwise(checks + dropped)).alias("considered"),
        F.sum(F.when(s("candidates_kept") != 0, s("candidates_kept")).otherwise(checks)).alias("kept"),
        F.sum(dropped).alias("dropped_before"),
        F.greatest(F.lit(0), F.sum("grounding_checks") - F.sum("grounding_pass")).alias("dropped_for_grounding"),
        F.sum("grounding_pass").alias("passed"),
    )
    return out.withColumn("yield_rate", rate(F.col("passed"), F.col("considered")))


def verdict_breakdown(facts: DataFrame, logs: DataFrame) -> DataFrame:
    """project_id, document_id, result, n: what the verifier said, by the document of its fact; null where the fact is not known."""
    said = logs.where("stage = 'independent_verify'").join(facts.select("fact_id", "document_id"), "fact_id", "left")
    return said.groupBy("project_id", "document_id", "result").agg(F.count(F.lit(1)).alias("n"))
