"""Concepts: whether two labels name the same thing, and the table of canonical names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import norm

#: Words that do not count, and the overlap under which labels are apart.
STOPWORDS = ("the", "of", "a", "an", "and", "for", "to", "in", "on", "s", "total")
LEAST_JACCARD = 0.2


def tokens(label: Column) -> Column:
    """The distinct words of a label."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def decide(pairs: DataFrame) -> DataFrame:
    """pairs (label_a, label_b) with method: exact, disjoint or model; same and canonical_name where known.

    Labels with the same words are the same, by the shorter label. Distinct pairs are few against
    facts: decide them once and join.
    """
    a, b = norm(F.col("label_a")), norm(F.col("label_b"))
    ta, tb = tokens(a), tokens(b)
    equal = a == b
    same_words = (F.size(ta) > 0) & (F.array_sort(ta) == F.array_sort(tb))
    apart = (jaccard(ta, tb) < LEAST_JACCARD) & ~(F.contains(b, a) | F.contains(a, b))
    shorter = F.when(F.length("label_b") < F.length("label_a"), F.trim("label_b")).otherwise(F.trim("label_a"))
    return pairs.withColumns(
        {
            "method": F.when(equal | same_words, "exact").when(apart, "disjoint").otherwise("model"),
            "same": F.when(equal | same_words, True).when(apart, False),
            "canonical_name": F.when(equal, F.trim("label_a")).when(same_words, shorter).when(apart, F.trim("label_a")),
        }
    )


def resolve(pairs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Distinct label pairs (project_id, kind, label_a, label_b), each resolved once: with method, same, canonical_name.

    answers are (kind, label_a, label_b, same_concept, answered_name, error), what a model says of open pairs; kind is a
    part of the question, as two labels may be one entity and two attributes.
    """
    decided = decide(pairs.select("project_id", "kind", "label_a", "label_b").distinct())
    if answers is None:
        answers = decided.sparkSession.createDataFrame([], "kind string, label_a string, label_b string, same_concept boolean, answered_name string, error string")
    keys = ["kind", "label_a", "label_b"]
    return with_answers(decided, answers.dropDuplicates(keys), keys)


def with_answers(decided: DataFrame, answers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """decided, the open ones by answers (label_a, label_b, same_concept, answered_name, error).

    Without an answer, or with an error, nothing is merged.
    """
    joined = decided.join(answers, keys or ["label_a", "label_b"], "left")
    failed = F.col("same_concept").isNull() | F.col("error").isNotNull()
    is_open = F.col("method") == "model"
    same = F.when(is_open, F.when(failed, False).otherwise(F.col("same_concept"))).otherwise(F.col("same"))
    name = F.when(is_open, F.when(same & (F.trim("answered_name") != ""), F.trim("answered_name")).otherwise(F.trim("label_a"))).otherwise(F.col("canonical_name"))
    return joined.withColumns({"method": F.when(is_open & failed, "model_error").otherwise(F.col("method")), "same": same, "canonical_name": name}).drop("same_concept", "answered_name", "error")


def upsert(concepts: DataFrame, seen: DataFrame) -> DataFrame:
    """concepts after new sightings (project_id, kind, canonical_name, alias, document_id, seen_at).

    Aliases are the sorted union, the first sighting stays the first.
    """
    new = seen.select("project_id", "kind", "canonical_name", F.array("alias").alias("raw_aliases"), F.col("document_id").alias("first_seen_document_id"), F.col("seen_at").alias("first_seen_at"))
    keys = ("project_id", "kind", "canonical_name")
    first = F.min(F.when(F.col("first_seen_at").isNotNull(), F.struct("first_seen_at", "first_seen_document_id")))
    exploded = concepts.select(*new.columns).unionByName(new).withColumn("alias", F.explode_outer("raw_aliases"))
    return exploded.groupBy(*keys).agg(F.sort_array(F.collect_set("alias")).alias("raw_aliases"), first.alias("f")).select(
        *keys, "raw_aliases", F.col("f.first_seen_document_id").alias("first_seen_document_id"), F.col("f.first_seen_at").alias("first_seen_at")
    )


def ontology(concepts: DataFrame, documents: DataFrame) -> DataFrame:
    """Concepts grouped by the document that showed them first; groups by file name, those without last."""
    named = concepts.join(documents.select(F.col("document_id").alias("first_seen_document_id"), "filename"), "first_seen_document_id", "left")
    seen = F.struct(F.col("first_seen_at").isNull().alias("late"), "first_seen_at", "kind", "canonical_name")
    grouped = named.groupBy("first_seen_document_id", "filename").agg(F.sort_array(F.collect_list(seen)).alias("seen"))
    return grouped.withColumn("concepts", F.transform("seen", lambda s: F.struct(s["kind"], s["canonical_name"]))).drop("seen").orderBy(F.col("filename").asc_nulls_last())
