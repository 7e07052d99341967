"""Verification: the state of a fact from its grounding, its verdicts and a blind second reading."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.qualifiers import assumptions
from factloom.operators.normalise import with_period
from factloom.operators.precheck import comparable, decide
from factloom.operators.tables import changes

#: The least confidence of a verdict; the scores of a second reading; how many are read twice.
LEAST = 0.5
SCORE, AGREE, DISAGREE, PER_FLAG, LOW, HIGH = 0.65, 0.25, -0.15, 0.10, 0.05, 0.99
READ_TWICE = 5


def verify(facts: DataFrame) -> DataFrame:
    """facts with verification_status, verifier_confidence and note.

    Columns read: grounded, reason; verdict_1, confidence_1, error_1; correction (null if none is
    safe); verdict_2, confidence_2, error_2. A verdict that is missing is an error.
    """
    c = F.col
    failed = lambda n: c(f"error_{n}").isNotNull() | c(f"verdict_{n}").isNull()
    good = lambda n: (c(f"verdict_{n}") == "supported") & (F.coalesce(c(f"confidence_{n}"), F.lit(0.0)) >= LEAST)
    s = lambda status, confidence, note: F.struct(F.lit(status).alias("status"), confidence.cast("double").alias("confidence"), note.alias("note"))
    none = F.lit(None)
    state = (
        F.when(~c("grounded"), s("rejected", none, F.concat(F.lit("not grounded: "), c("reason"))))
        .when(failed(1), s("needs_review", none, F.lit("no verdict")))
        .when(good(1), s("verified", c("confidence_1"), none.cast("string")))
        .when(c("correction").isNull(), s("needs_review", c("confidence_1"), F.lit("no safe correction")))
        .when(failed(2), s("needs_review", c("confidence_1"), F.lit("no second verdict")))
        .when(good(2), s("auto_corrected", c("confidence_2"), F.concat(F.lit("corrected: "), c("correction"))))
        .otherwise(s("needs_review", c("confidence_2"), F.lit("the correction did not help")))
    )
    return facts.withColumn("_s", state).withColumns({"verification_status": c("_s.status"), "verifier_confidence": c("_s.confidence"), "note": c("_s.note")}).drop("_s")


def log_entries(facts: DataFrame) -> DataFrame:
    """fact_id, stage, result, attempt: what verify's steps leave in the log."""
    c = F.col
    entry = lambda stage, result, n: F.struct(F.lit(stage).alias("stage"), result.alias("result"), F.lit(n).alias("attempt"))
    result = lambda n: F.when(c(f"error_{n}").isNotNull() | c(f"verdict_{n}").isNull(), "error").otherwise(c(f"verdict_{n}"))
    supported = (c("verdict_1") == "supported") & (c("confidence_1") >= LEAST) & c("error_1").isNull()
    second = c("grounded") & c("correction").isNotNull() & (result(1) != "error") & ~F.coalesce(supported, F.lit(False))
    entries = F.array_compact(
        F.array(
            entry("grounding_check", F.when(c("grounded"), "pass").otherwise("fail"), 1),
            F.when(c("grounded"), entry("independent_verify", result(1), 1)),
            F.when(second, entry("independent_verify", result(2), 2)),
        )
    )
    return facts.select("fact_id", F.explode(entries).alias("e")).select("fact_id", "e.*")


def dual_score(agree: Column, flags: Column) -> Column:
    raw = SCORE + F.when(agree, AGREE).otherwise(DISAGREE) - PER_FLAG * F.size(flags)
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), raw))


def corroborate(primary: DataFrame, blind: DataFrame) -> DataFrame:
    """primary with agrees, blind_facts, confidence and status after a blind reading of the same chunk.

    A verified fact that the second reading does not bear out needs a review.
    """
    key = ["document_id", "chunk_index"]
    a = comparable(primary)
    b = comparable(blind).select(*key, F.col("cmp").alias("_other"))
    seen = (
        a.select("fact_id", *key, "cmp")
        .join(b, key)
        .groupBy("fact_id")
        .agg(F.max(decide(F.col("cmp"), F.col("_other"))["outcome"] == "corroborates").alias("agrees"), F.count(F.lit(1)).alias("blind_facts"))
    )
    flags = assumptions(F.col("fact_kind"), F.col("entity_resolved"), F.col("value.comparator"), F.col("_period"))
    agrees = F.coalesce("agrees", F.lit(False))
    demoted = ~agrees & F.col("verification_status").isin("verified", "auto_corrected")
    known = with_period(primary, F.col("period.raw_label"), "_period")
    return known.join(seen, "fact_id", "left").withColumns(
        {
            "agrees": agrees,
            "blind_facts": F.coalesce("blind_facts", F.lit(0)),
            "confidence": dual_score(agrees, flags),
            "status": F.when(demoted, "needs_review").otherwise(F.col("verification_status")),
        }
    ).drop("_period")


def read_twice(facts: DataFrame, *, terms: tuple[str, ...] = (), limit: int = READ_TWICE, every: bool = False) -> DataFrame:
    """Anchored facts of a document to be read twice: all that name a term, then the least sure up to the limit."""
    anchored = facts.where(F.col("anchor").isNotNull())
    if every:
        return anchored
    text = F.lower(F.concat_ws(" ", "entity", "attribute"))
    named = F.lit(False)
    for t in terms:
        named = named | F.contains(text, F.lit(t.lower()))
    sure = F.coalesce("verifier_confidence", "extraction_confidence")
    place = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("_named"), sure, "fact_id"))
    return anchored.withColumn("_named", named).withColumn("_place", place).where(F.col("_named") | (F.col("_place") <= limit)).drop("_named", "_place")


def apply(facts: DataFrame, verified: DataFrame) -> DataFrame:
    """facts after a verification: status and confidence replaced, notes and corrections appended, corrected fields overwritten.

    facts have notes (array of strings) and corrections (array of structs fact_id, corrected_by, changes); verified has fact_id,
    verification_status, verifier_confidence, note, and corrected, a struct of entity, attribute, value, period
    and qualifiers that is null where nothing was corrected. Facts that were not verified stay; verdicts on facts
    that are not there are passed over. A correction that changes nothing leaves no record.
    """
    fields = ["entity", "attribute", "value", "period", "qualifiers"]
    new = verified.select("fact_id", F.col("verification_status").alias("_status"), F.col("verifier_confidence").alias("_sure"), F.col("note").alias("_note"), F.col("corrected").alias("_new"), F.lit(True).alias("_seen"))
    joined = facts.join(new, "fact_id", "left")
    was, now, seen = F.struct(*fields), F.col("_new"), F.col("_seen").isNotNull()
    diff = changes(was, now, fields)
    record = F.struct("fact_id", F.lit("verifier").alias("corrected_by"), diff.alias("changes"))
    made = now.isNotNull() & (F.size(diff) > 0)
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    kind = dict(facts.dtypes)
    return joined.withColumns(
        {
            "verification_status": F.when(seen, F.col("_status")).otherwise(F.col("verification_status")),
            "verifier_confidence": F.when(seen, F.col("_sure")).otherwise(F.col("verifier_confidence")),
            "notes": F.concat(empty("notes", kind["notes"]), F.array_compact(F.array("_note"))),
            "corrections": F.when(made, F.concat(empty("corrections", kind["corrections"]), F.array(record.cast(kind["corrections"].removeprefix("array<").removesuffix(">"))))).otherwise(empty("corrections", kind["corrections"])),
            **{f: F.when(now.isNotNull(), now[f]).otherwise(F.col(f)) for f in fields},
        }
    ).select(*facts.columns)


def statistics(verified: DataFrame, logs: DataFrame) -> DataFrame:
    """A row per document: facts by outcome, grounding failures, correction attempts, verifier calls and errors."""
    status = F.col("verification_status")
    outcomes = verified.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("facts_in"), *[F.count_if(status == s).alias(s) for s in ("verified", "auto_corrected", "needs_review", "rejected")],
        F.count_if(status == "rejected").alias("grounding_failures"), F.count_if(F.col("correction").isNotNull()).alias("correction_attempts"),
    )
    asked = logs.where("stage = 'independent_verify'").join(verified.select("fact_id", "document_id"), "fact_id")
    calls = asked.groupBy("document_id").agg(F.count_if(F.col("result") != "error").alias("verifier_calls"), F.count_if(F.col("result") == "error").alias("verifier_errors"))
    return outcomes.join(calls, "document_id", "left").na.fill(0)
