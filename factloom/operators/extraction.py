"""Extraction: what becomes of the facts that a model proposes for a chunk."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.qualifiers import assumptions, penalised
from factloom.functions.repair import repair_comparators
from factloom.functions.text import blank_to_null
from factloom.operators import provider
from factloom.operators.grounding import anchor
from factloom.operators.normalise import with_period

#: Keys that name a figure's column in a table.
COLUMN_KEYS = ("column_header", "column", "col_header", "col")
KINDS = ("quantitative", "status", "qualitative")
#: Fixed value: the error of a provider that turns a request's schema down.
SCHEMA_ERROR = "schema_rejected"
#: Why a proposed fact is dropped.
DROPPED = ("invalid", "no_chunk", "no_column_context")


def finalise(proposed: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): proposed facts of chunks (document_id, chunk_index), repaired, anchored and marked.

    Dropped are facts that are not valid (`invalid`: no known kind, entity, attribute or evidence,
    or no value of their kind), then those whose chunk is not there (`no_chunk`), then figures of a
    table without the name of their column (`no_column_context`). Confidence is held to the chunk's ceiling, then pays for assumptions.
    """
    c = F.col
    blank = lambda x: F.coalesce(blank_to_null(x), F.lit("")) == ""
    has_value = (
        F.when(c("fact_kind") == "quantitative", c("value.number").isNotNull() | c("value.number_high").isNotNull())
        .when(c("fact_kind") == "status", ~blank(c("value.state")))
        .otherwise(~blank(c("value.text")))
    )
    valid = c("fact_kind").isin(*KINDS) & ~blank(c("entity")) & ~blank(c("attribute")) & ~blank(c("evidence_text")) & has_value
    places = chunks.select("document_id", "chunk_index", "text", "char_start", "confidence_ceiling", (~blank(c("table_markdown"))).alias("_table"), F.lit(True).alias("_there"))
    named = F.arrays_overlap(F.coalesce(F.map_keys("qualifiers"), F.array().cast("array<string>")), F.array(*map(F.lit, COLUMN_KEYS)))
    reason = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(c("_there").isNull(), "no_chunk").when(c("_table") & (c("fact_kind") == "quantitative") & ~named, "no_column_context")
    judged = lambda facts: facts.join(places, ["document_id", "chunk_index"], "left").withColumn("drop_reason", reason)
    dropped = judged(proposed).where("drop_reason IS NOT NULL").select(*proposed.columns, "drop_reason")
    # Labels are read from what is proposed, as their dictionary would otherwise join facts to their chunks once more.
    known = judged(with_period(proposed, c("period.raw_label"), "_period").where(valid))
    flagged = anchor(repair_comparators(known.where("drop_reason IS NULL"))).withColumn("assumed", assumptions(c("fact_kind"), c("entity_resolved"), c("value.comparator"), c("_period")))
    note = F.when(c("anchor_start").isNull(), "evidence not found in the chunk").when(~c("exact"), "evidence found by its form")
    kept = flagged.withColumns(
        {"extraction_confidence": penalised(F.least("extraction_confidence", "confidence_ceiling"), c("assumed")), "notes": F.array_compact(F.array(note)), "verification_status": F.lit("pending")}
    ).drop("text", "char_start", "confidence_ceiling", "_table", "_there", "_period", "drop_reason")
    return kept, dropped


def statistics(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """A row per document: facts kept, repaired, unanchored and dropped, by reason."""
    a = kept.groupBy("document_id").agg(F.count(F.lit(1)).alias("candidates_kept"), F.count_if("repaired").alias("repaired"), F.count_if(F.col("anchor_start").isNull()).alias("unanchored"))
    b = dropped.groupBy("document_id").agg(*[F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in DROPPED])
    out = a.join(b, "document_id", "full").na.fill(0)
    return out.withColumn("candidates_returned", sum((F.col(f"dropped_{r}") for r in DROPPED), F.col("candidates_kept")))


def by_kind(kept: DataFrame) -> DataFrame:
    """document_id, by_kind: a map from each kind to the facts kept of it."""
    counts = kept.groupBy("document_id", "fact_kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fact_kind", "n")))).alias("by_kind"))


def ask(batches: DataFrame, constrained: DataFrame, free: DataFrame) -> DataFrame:
    """batches (request_key, ...) with text, error_type, calls and failed.

    A batch whose schema the provider turns down is asked once more without one. Any other error, or
    a text that is no list of facts, fails that batch alone.
    """
    first = provider.answer(batches, constrained)
    second = free.select("request_key", F.col("text").alias("_t"), F.col("error_type").alias("_e"), F.lit(True).alias("_f"))
    again = F.coalesce(F.col("error_type") == SCHEMA_ERROR, F.lit(False))
    joined = first.join(second, "request_key", "left").withColumn("_again", again)
    error = F.when(~F.col("_again"), F.col("error_type")).when(F.col("_f").isNull(), "missing").otherwise(F.col("_e"))
    text = F.when(F.col("_again"), F.when(F.col("_e").isNull(), F.col("_t"))).otherwise(F.col("text"))
    out = joined.withColumns({"calls": F.when(F.col("_again"), 2).otherwise(1), "_error": error, "_text": text}).drop("text", "error_type", "provider", "_t", "_e", "_f", "_again")
    listed = F.get_json_object("_text", "$.facts")
    bad = F.when(F.col("_error").isNotNull(), F.col("_error")).when(~F.coalesce(F.startswith(listed, F.lit("[")), F.lit(False)), "no facts")
    return out.withColumns({"text": F.col("_text"), "error_type": bad, "failed": bad.isNotNull()}).drop("_text", "_error")


def proposed(answered: DataFrame, fact: str) -> DataFrame:
    """A row for each fact of the answers that did not fail; fact is the schema of one. Elements that are no objects are null."""
    # Element by element, so that one that is no object does not take the others with it.
    facts = F.transform(F.from_json(F.get_json_object("text", "$.facts"), "array<string>"), lambda e: F.from_json(e, fact))
    return answered.where("NOT failed").withColumn("fact", F.explode(facts)).drop("text", "error_type", "failed", "calls")
