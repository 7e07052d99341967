"""Changes to tables: keyed replacement, cascades, corrections; and the lists that read them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An upload's largest size, and the states from which a document may be tried again.
MOST_BYTES = 60 * 1024 * 1024
RETRIED = ("failed", "extraction_unavailable")


def intake(files: DataFrame, documents: DataFrame) -> DataFrame:
    """files (project_id, path, content) with content_hash and reject_reason.

    Of files with the same content in a project the first path is taken.
    """
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    known = documents.select("project_id", "content_hash").distinct().withColumn("_known", F.lit(True))
    first = hashed.groupBy("project_id", "content_hash").agg(F.min("path").alias("_first"))
    size = F.octet_length("content")
    reason = (
        F.when(size == 0, "empty")
        .when(size > MOST_BYTES, "too large")
        .when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "not a PDF")
        .when(F.col("_known") | (F.col("path") != F.col("_first")), "duplicate")
    )
    return hashed.join(known, ["project_id", "content_hash"], "left").join(first, ["project_id", "content_hash"]).withColumn("reject_reason", reason).drop("_known", "_first")


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows that new has keys of, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_pending(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Pending facts of the documents that new has go, and new comes; others stay."""
    docs = new.select("document_id").distinct()
    pending = facts.where("verification_status = 'pending'").join(docs, "document_id", "left_anti")
    return facts.where("verification_status <> 'pending'").unionByName(pending).unionByName(new)


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, facts: DataFrame, edges: DataFrame, logs: DataFrame, concepts: DataFrame) -> dict[str, DataFrame]:
    """The tables without the documents `gone` and what hangs on them; concepts lose the mention only."""
    ids = gone.select("document_id").distinct()
    left = facts.join(ids, "document_id", "left_anti")
    lost = facts.join(ids, "document_id", "left_semi").select("fact_id")
    of = lambda c: lost.withColumnRenamed("fact_id", c)
    mention = ids.withColumnRenamed("document_id", "first_seen_document_id").withColumn("_gone", F.lit(True))
    return {
        "documents": documents.join(ids, "document_id", "left_anti"),
        "chunks": chunks.join(ids, "document_id", "left_anti"),
        "facts": left,
        "fact_relationships": edges.join(of("fact_id_a"), "fact_id_a", "left_anti").join(of("fact_id_b"), "fact_id_b", "left_anti"),
        "verification_logs": logs.join(lost, "fact_id", "left_anti"),
        "canonical_concepts": concepts.join(mention, "first_seen_document_id", "left")
        .withColumn("first_seen_document_id", F.when(F.col("_gone").isNull(), F.col("first_seen_document_id")))
        .drop("_gone"),
    }


def delete_project(project_id: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: df.where(F.col("project_id") != project_id) for name, df in tables.items()}


def retry(documents: DataFrame) -> DataFrame:
    """Documents that may be tried again are queued anew."""
    again = F.col("processing_status").isin(*RETRIED)
    return documents.withColumn("processing_status", F.when(again, "queued").otherwise(F.col("processing_status")))


def changes(old: Column, new: Column, fields: list[str]) -> Column:
    """A map from each field that differs to its old and new value, as JSON."""
    as_json = lambda s, f: F.to_json(F.struct(s[f].alias("v")))
    entries = [F.struct(F.lit(f).alias("key"), F.struct(as_json(old, f).alias("old"), as_json(new, f).alias("new")).alias("value")) for f in fields]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: ~e["value"]["old"].eqNullSafe(e["value"]["new"])))


def list_facts(facts: DataFrame, *, offset: int = 0, limit: int = 200, **equal: str) -> DataFrame:
    """A page of facts by falling time, with equality filters; limit is 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    out = facts
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("created_at"), "fact_id").offset(offset).limit(limit)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("project_id", column).agg(F.count(F.lit(1)).alias("n"))
