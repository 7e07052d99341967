"""Comparing new facts with those that are there: nearest facts, new pairs, concepts, rules, edges.

`compare` stops at the rules. `compare_document` goes all the way: labels that name the same thing are resolved once for each pair
of labels, the rules decide what they can, a model's verdicts decide the rest, some after a bounded look for context, and
each edge carries the trail of how it was found. Model calls are tables of responses.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import norm
from factloom.operators import adjudication, candidates, concepts, precheck, relationships
from factloom.schemas import COMPARED
from factloom.sources.shared import durable

NEAREST = 8


def canonical(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """facts with canonical_entity and canonical_attribute, where a concept has the name among its aliases."""
    out = facts
    for kind in ("entity", "attribute"):
        known = concepts.where(F.col("kind") == kind).select("project_id", F.explode("raw_aliases").alias(kind), F.col("canonical_name").alias(f"canonical_{kind}"))
        one = known.groupBy("project_id", kind).agg(F.min(f"canonical_{kind}").alias(f"canonical_{kind}"))
        out = out.join(one, ["project_id", kind], "left")
    return out


def compare(facts: DataFrame, edges: DataFrame, concepts: DataFrame, new: DataFrame | None = None, *, k: int = NEAREST, most: float | None = candidates.MOST_DISTANT) -> tuple[DataFrame, DataFrame]:
    """(decided pairs, new edges): usable facts against their nearest of the same kind.

    With new (fact_id), only those facts ask. A pair that has an edge is not decided again.
    """
    usable = facts.where(F.col("verification_status").isin(*COMPARED))
    if new is not None:
        usable = usable.join(new.select("fact_id").withColumn("_asks", F.lit(True)), "fact_id", "left").withColumn("_asks", F.coalesce("_asks", F.lit(False)))
    near = candidates.nearest(usable, k=k, most=most, of=None if new is None else F.col("_asks"))
    pairs = relationships.new_pairs(relationships.ordered(near.select("fact", "other", "distance")), edges)
    ready = precheck.comparable(canonical(usable, concepts)).select("fact_id", "cmp")
    side = lambda s: ready.select(F.col("fact_id").alias(f"fact_id_{s}"), F.col("cmp").alias(f"cmp_{s}"))
    decided = (
        pairs.join(side("a"), "fact_id_a")
        .join(side("b"), "fact_id_b")
        .withColumn("check", precheck.decide(F.col("cmp_a"), F.col("cmp_b")))
        .select("fact_id_a", "fact_id_b", "distance", "check.*")
    )
    return decided, relationships.from_checks(decided)


@dataclass
class Answers:
    """What models say: of labels (see concepts.resolve), of pairs, of steps of a look, what tools give, and final verdicts (see adjudication)."""

    verdicts: DataFrame
    labels: DataFrame | None = None
    steps: DataFrame | None = None
    results: DataFrame | None = None
    final: DataFrame | None = None


@dataclass
class Comparison:
    """pairs: what the rules say of each new pair; edges: the new ones; merges: labels found to be one (project_id, kind,
    label_a, label_b, canonical_name, document_id); statistics: a row for each project."""

    pairs: DataFrame
    edges: DataFrame
    merges: DataFrame
    statistics: DataFrame


def _labels(sided: DataFrame) -> DataFrame:
    """The two labels of each pair by kind, in one order, so that a pair of labels is asked about once."""
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_a").alias("x"), F.col(f"{kind}_b").alias("y")) for kind in ("entity", "attribute")])
    rows = sided.select("project_id", "document_id", F.explode(both).alias("l")).select("project_id", "document_id", "l.*")
    turned = F.struct(norm(F.col("x")), F.col("x")) > F.struct(norm(F.col("y")), F.col("y"))
    return rows.select("project_id", "document_id", "kind", F.when(turned, F.col("y")).otherwise(F.col("x")).alias("label_a"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("label_b"))


def _one_name(sided: DataFrame, known: DataFrame) -> DataFrame:
    """sided with the names of both facts replaced by the canonical one, where their labels are one concept."""
    out = sided
    for kind in ("entity", "attribute"):
        same = known.where((F.col("kind") == kind) & F.col("same")).select("project_id", F.col("label_a").alias("_x"), F.col("label_b").alias("_y"), norm(F.col("canonical_name")).alias("_name"))
        either = same.unionByName(same.select("project_id", F.col("_y").alias("_x"), F.col("_x").alias("_y"), "_name")).dropDuplicates(["project_id", "_x", "_y"])
        joined = out.withColumns({"_x": F.col(f"{kind}_a"), "_y": F.col(f"{kind}_b")}).join(either, ["project_id", "_x", "_y"], "left")
        named = lambda s: F.col(f"cmp_{s}").withField(kind, F.coalesce("_name", F.col(f"cmp_{s}")[kind]))  # noqa: B023, E731
        out = joined.withColumns({"cmp_a": named("a"), "cmp_b": named("b")}).drop("_x", "_y", "_name")
    return out


def compare_document(facts: DataFrame, edges: DataFrame, answers: Answers, new: DataFrame | None = None, *, off_domain: bool = False, reconcile: bool = True, k: int = NEAREST, most: float | None = candidates.MOST_DISTANT) -> Comparison:
    """Usable facts, those of `new` (fact_id) or all, against their nearest of the same kind, to the last edge.

    Facts of a document that is off its project's domain ask for few and near facts only. A pair that has an edge is not
    looked at again. A verdict with an error makes no edge, nor does `unrelated`, unless a look for context came to it.
    """
    if off_domain:
        k, most = candidates.FAR_NEAREST, candidates.FAR_MOST_DISTANT
    usable = facts.where(F.col("verification_status").isin(*COMPARED))
    asks = usable if new is None else usable.join(new.select("fact_id").distinct(), "fact_id", "left_semi")
    if new is not None:
        usable = usable.join(new.select("fact_id").distinct().withColumn("_asks", F.lit(True)), "fact_id", "left").withColumn("_asks", F.coalesce("_asks", F.lit(False)))
    near = candidates.nearest(usable, k=k, most=most, of=None if new is None else F.col("_asks"))
    pairs = relationships.new_pairs(relationships.ordered(near.select("project_id", "fact", "other", "distance")), edges)
    ready = precheck.comparable(usable).select("project_id", "fact_id", "document_id", "entity", "attribute", "cmp")
    side = lambda s, *more: ready.select("project_id", *[F.col(c).alias(f"{c}_{s}") for c in ("fact_id", "entity", "attribute", "cmp")], *more)
    sided = durable(pairs.join(side("a", "document_id"), ["project_id", "fact_id_a"]).join(side("b"), ["project_id", "fact_id_b"]))
    labels = _labels(sided)
    known = durable(concepts.resolve(labels, answers.labels))
    named = _one_name(sided, known)
    keys = list(adjudication.PAIR)
    checked = durable(
        named.withColumn("check", precheck.decide(F.col("cmp_a"), F.col("cmp_b")))
        .withColumn("detail", F.when(F.col("check.outcome") == "corroborates", precheck.detail(F.col("cmp_a"), F.col("cmp_b"))))
        .select("project_id", *keys, "distance", "check.*", "detail")
    )
    undecided = checked.where("outcome = 'needs_adjudication'").select(*keys)
    first = durable(adjudication.verdicts(undecided, answers.verdicts))
    looks = reconcile and answers.steps is not None
    made = adjudication.adjudicate(undecided, answers.verdicts, *((answers.steps, answers.results, answers.final) if looks else ()))
    rules: Column = adjudication.by_rules(detail=F.to_json("detail"))
    agreed = checked.where("outcome = 'corroborates'").select(
        "project_id", *keys, F.lit("corroborates").alias("type"), F.lit(None).cast("string").alias("basis"), F.col("reason").alias("explanation"), F.lit(relationships.AGREED_CONFIDENCE).alias("confidence"), rules.alias("trail")
    )
    told = made.join(checked.select("project_id", *keys, "reason"), keys)
    judged = told.select("project_id", *keys, "type", "basis", "explanation", "confidence", F.concat(adjudication.by_rules(reason=F.col("reason")), "trail").alias("trail"))
    found = durable(agreed.unionByName(judged))
    merges = known.where("same").join(labels.groupBy("project_id", "kind", "label_a", "label_b").agg(F.min("document_id").alias("document_id")), ["project_id", "kind", "label_a", "label_b"])
    return Comparison(checked, found, merges.select("project_id", "kind", "label_a", "label_b", "canonical_name", "document_id"), _statistics(asks, checked, first, found, looks))


def _statistics(asks: DataFrame, checked: DataFrame, first: DataFrame, found: DataFrame, looks: bool) -> DataFrame:
    """project_id and what was looked at, decided and recorded; by_type counts the new edges."""
    said = checked.where("outcome = 'needs_adjudication'").select("project_id", *adjudication.PAIR).join(first, list(adjudication.PAIR))
    rules = checked.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("candidate_pairs"), F.count_if(F.col("outcome") == "corroborates").alias("precheck_corroborates"), F.count_if(F.col("outcome") == "not_comparable").alias("precheck_not_comparable")
    )
    models = said.groupBy("project_id").agg(
        F.count_if(F.col("error").isNull()).alias("adjudicated"), F.count_if(F.col("error").isNotNull()).alias("adjudication_errors"),
        F.count_if(F.col("error").isNull() & F.coalesce("needs_more_context", F.lit(False)) & F.lit(looks)).alias("reconciled"),
    )
    types = found.groupBy("project_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("project_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    counts = asks.groupBy("project_id").agg(F.count(F.lit(1)).alias("facts_considered")).join(rules, "project_id", "left").join(models, "project_id", "left")
    return counts.na.fill(0).join(types, "project_id", "left").withColumn("by_type", F.coalesce("by_type", F.create_map().cast("map<string,bigint>")))


def seen(merges: DataFrame, at: Column) -> DataFrame:
    """What concepts.upsert takes: a sighting of each label of the merges, at the time `at`."""
    return merges.select("project_id", "kind", "canonical_name", F.explode(F.array("label_a", "label_b")).alias("alias"), "document_id", at.alias("seen_at")).distinct()
