"""Adjudication: what a model's verdicts about undecided pairs come to, and the bounded look for more context.

Model calls are tables of responses, as in provider: a missing response is the error `missing`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.render import fence
from factloom.functions.text import is_object, strip
from factloom.functions.values import plain_number
from factloom.operators.search import MOST_RESULT, TOOL_CALLS
from factloom.schemas import RELATIONS

#: The fields of a verdict that tell how it was reached, and the tools that may be called.
REASONING = ("entity_match", "attribute_match", "period_relation", "unit_scale_note", "qualifier_explanation", "comparator_consistent")
TOOLS = ("search_facts", "search_evidence_text", "get_surrounding_context")
PAYLOAD = "relationship_type string, reconciliation_basis string, explanation string, confidence double, needs_more_context boolean, missing_context string, " + ", ".join(f"{c} string" for c in REASONING)
DECISION = "action string, tool string, query string, fact_id string, rationale string"
#: What an entry of a trail may tell. Step 0 is that of the rules: method, and their reason or, as JSON, the detail that decided.
ENTRY_FIELDS = {
    "step": "int", "action": "string", "tool": "string", "query": "string", "fact_id": "string", "rationale": "string", "result": "string", "error": "string", "verdict": "string", "basis": "string",
    "budget_exhausted": "boolean", "method": "string", "reason": "string", "detail": "string",
}
ENTRY = f"struct<{','.join(f'{n}:{kind}' for n, kind in ENTRY_FIELDS.items())}>"
TRAIL = f"array<{ENTRY}>"
PAIR = ("fact_id_a", "fact_id_b")


def fact_block(tag: Column, fact: Column, evidence: Column) -> Column:
    """A fact as an adjudicator reads it, line by line; the evidence is fenced."""
    v = fact["value"]
    figure = F.concat(
        F.coalesce(v["comparator"], F.lit("eq")), F.lit(" "), F.coalesce(plain_number(v["number"]), F.lit("?")),
        F.coalesce(F.concat(F.lit(".."), plain_number(v["number_high"])), F.lit("")), F.lit(" "), F.coalesce(v["unit"], F.lit("")),
    )
    other = F.coalesce(F.when(v["state"] != "", v["state"]), F.when(v["text"] != "", v["text"]), F.lit("?"))
    qualifiers = F.array_join(F.transform(F.array_sort(F.map_entries(fact["qualifiers"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    lines = {
        "entity": fact["entity"], "attribute": fact["attribute"], "kind": fact["fact_kind"], "value": F.trim(F.when(fact["fact_kind"] == "quantitative", figure).otherwise(other)),
        "period": F.coalesce(F.when(fact["period"]["raw_label"] != "", fact["period"]["raw_label"]), F.lit("(none)")), "qualifiers": F.coalesce(F.when(qualifiers != "", qualifiers), F.lit("(none)")),
        "evidence": F.concat(F.lit('""" '), fence(strip(evidence)), F.lit(' """')),
    }
    return F.concat_ws("\n", F.concat(F.lit("FACT "), tag), *[F.concat(F.lit(f"  {name}: "), F.coalesce(value, F.lit(""))) for name, value in lines.items()])


def verdicts(pairs: DataFrame, answers: DataFrame, *, final: bool = False) -> DataFrame:
    """pairs (fact_id_a, fact_id_b) with type, basis, explanation, confidence, needs_more_context, missing_context, reasoning, error.

    answers are (fact_id_a, fact_id_b, text, error_type). A text that is no object, or names no known
    type, is the error `invalid`. A basis stands only with a reconciled pair, confidence is held to 0..1,
    and a final verdict asks for no more context.
    """
    said = answers.select(*PAIR, F.from_json("text", PAYLOAD).alias("_p"), F.col("error_type").alias("_e"), F.lit(True).alias("_there"))
    p = F.col("_p")
    known = F.coalesce(p["relationship_type"].isin(*RELATIONS), F.lit(False))
    error = F.when(F.col("_there").isNull(), "missing").when(F.col("_e").isNotNull(), F.col("_e")).when(~known, "invalid")
    good = lambda c: F.when(F.col("error").isNull(), c)
    blank = lambda c: F.when(F.trim(c) != "", c)
    more = F.lit(False) if final else F.coalesce(p["needs_more_context"], F.lit(False))
    dropped = F.coalesce(p["needs_more_context"], F.lit(False)) if final else F.lit(False)
    return (
        pairs.join(said, list(PAIR), "left")
        .withColumn("error", error)
        .withColumns(
            {
                "type": good(p["relationship_type"]),
                "basis": good(F.when(p["relationship_type"] == "reconciled_by_context", blank(p["reconciliation_basis"]))),
                "explanation": good(strip(F.coalesce(p["explanation"], F.lit("")))),
                "confidence": good(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p["confidence"], F.lit(0.0))))),
                "needs_more_context": good(more),
                "missing_context": good(F.when(~dropped, blank(p["missing_context"]))),
                "reasoning": good(F.struct(*[p[c].alias(c) for c in REASONING])),
            }
        )
        .drop("_p", "_e", "_there")
    )


def _entry(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in ENTRY_FIELDS]).cast(ENTRY)


def by_rules(**told: Column) -> Column:
    """Step 0 of a trail, as a trail of its own."""
    return F.array(_entry(step=F.lit(0), method=F.lit("deterministic_precheck"), **told)).cast(TRAIL)


def reconcile(pairs: DataFrame, steps: DataFrame, results: DataFrame, final: DataFrame, *, most: int = TOOL_CALLS) -> DataFrame:
    """pairs with the final verdict, trail, tool_calls, budget_exhausted and findings.

    steps are (fact_id_a, fact_id_b, step, text, error_type), what a planner says at steps 1 to `most`; results are
    (tool, query, fact_id, output), what the tools give. The look ends with the first step that finishes, fails, or
    names no known tool; a text that is no JSON object fails; a call that gives nothing counts as a call. Then final, as
    the answers of verdicts, decides.
    """
    keys = list(PAIR)
    asked = pairs.select(*PAIR).distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(most))))
    said = steps.select(*PAIR, F.col("step").cast("int").alias("step"), F.from_json("text", DECISION).alias("d"), F.col("error_type").alias("e"), is_object(F.col("text")).alias("object"), F.lit(True).alias("there"))
    d = F.col("d")
    calls = F.coalesce(d["action"] == "use_tool", F.lit(False))
    known = F.coalesce(d["tool"].isin(*TOOLS), F.lit(False))
    error = F.when(F.col("there").isNull(), "missing").when(F.col("e").isNotNull(), F.substring("e", 1, 200)).when(~F.col("object"), "no JSON object").when(calls & ~known, F.concat(F.lit("invalid tool "), F.coalesce(d["tool"], F.lit("none"))))
    planned = asked.join(said, [*keys, "step"], "left").withColumn("error", error).withColumn("ends", F.col("error").isNotNull() | ~calls)
    # Dealt into all partitions, which are not merged: a step is a few bytes, but with what its tool gives it is some thousand.
    planned = planned.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    before = W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    taken = planned.withColumn("over", F.coalesce(F.max(F.col("ends").cast("int")).over(before), F.lit(0))).where("over = 0")
    outputs = results.select(F.col("tool").alias("_tool"), F.col("query").alias("_query"), F.col("fact_id").alias("_fact"), "output").dropDuplicates(["_tool", "_query", "_fact"])
    called = taken.join(outputs, (~F.col("ends")) & (d["tool"] == F.col("_tool")) & d["query"].eqNullSafe(F.col("_query")) & d["fact_id"].eqNullSafe(F.col("_fact")), "left")
    output = F.coalesce("output", F.lit(""))
    why = F.coalesce(d["rationale"], F.lit(""))
    entry = (
        F.when(F.col("error").isNotNull(), _entry(step=F.col("step"), error=F.col("error")))
        .when(F.col("ends"), _entry(step=F.col("step"), action=F.lit("finish"), rationale=why))
        .otherwise(_entry(step=F.col("step"), action=F.lit("use_tool"), tool=d["tool"], query=d["query"], fact_id=d["fact_id"], rationale=why, result=F.substring(output, 1, MOST_RESULT)))
    )
    finding = F.when(~F.col("ends"), F.concat(F.lit("["), d["tool"], F.lit("] "), output))
    looked = called.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("step", entry.alias("entry"), finding.alias("finding")))).alias("_all"),
        F.count_if(~F.col("ends")).cast("int").alias("tool_calls"),
    )
    decided = verdicts(pairs, final, final=True).join(looked, keys)
    last = _entry(
        step=(F.size("_all") + 1), action=F.lit("final_classification"), verdict=F.col("type"), basis=F.col("basis"), error=F.col("error"), budget_exhausted=F.col("tool_calls") >= most
    )
    trail = F.concat(F.transform("_all", lambda x: x["entry"]), F.array(last).cast(TRAIL)).cast(TRAIL)
    found = F.array_join(F.transform("_all", lambda x: x["finding"]), "\n\n")
    return decided.withColumns(
        {"trail": trail, "budget_exhausted": F.col("tool_calls") >= most, "findings": F.coalesce(F.when(found != "", found), F.lit("(no additional context could be found)"))}
    ).drop("_all")


def adjudicate(pairs: DataFrame, answers: DataFrame, steps: DataFrame | None = None, results: DataFrame | None = None, final: DataFrame | None = None) -> DataFrame:
    """Edges from undecided pairs: type, basis, explanation, confidence, trail.

    Pairs whose verdict asks for more context are looked into, if steps are given. A verdict with an error makes no
    edge; nor does `unrelated`, unless it comes from such a look.
    """
    first = verdicts(pairs, answers)
    columns = (*PAIR, "type", "basis", "explanation", "confidence")
    none = F.array().cast(TRAIL).alias("trail")
    if steps is None:
        return first.where("error IS NULL AND type <> 'unrelated'").select(*columns, none)
    at_once = first.where("error IS NULL AND NOT needs_more_context AND type <> 'unrelated'").select(*columns, none)
    looked = reconcile(first.where("needs_more_context").select(*PAIR), steps, results, final).where("error IS NULL").select(*columns, "trail")
    return at_once.unionByName(looked)
