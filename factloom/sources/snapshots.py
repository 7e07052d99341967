"""Snapshots of whole projects: folders of JSON lines in which rows name each other by symbolic references, not by ids.

A snapshot holds a folder for each table, parted by project, and a manifest that is written last. It is written beside its place and moved
there when it is whole, so that a write that fails leaves nothing behind and a reader never sees half of one. Ids are made from the references
as they are read: a hash of project, table and reference, the same in every run. A table that has a column `ref` keeps it; in others
the id itself is the reference. So what was read from a snapshot and is saved reads back as the same tables, however many projects
there are. Rows are never gathered by project: each table is read and written in parallel.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schemas import TABLES

#: The id of each table, and the columns that hold ids of other tables.
IDS = {"documents": "document_id", "facts": "fact_id", "fact_relationships": "relationship_id", "verification_logs": "log_id", "chunks": None, "canonical_concepts": None}
REFERENCES = {
    "chunks": {"document_id": "documents"},
    "facts": {"document_id": "documents"},
    "fact_relationships": {"fact_id_a": "facts", "fact_id_b": "facts"},
    "verification_logs": {"fact_id": "facts"},
    "canonical_concepts": {"first_seen_document_id": "documents"},
}
MANIFEST = "manifest.json"


def project_id(name: Column) -> Column:
    return F.sha2(F.concat(F.lit("project:"), name), 256)


def made_id(project: Column, table: str, ref: Column) -> Column:
    """The id of a reference; null for none."""
    return F.when(ref.isNotNull(), F.sha2(F.concat_ws(":", project, F.lit(table), ref), 256))


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    files, at = _files(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _referred(df: DataFrame, column: str, table: str, tables: dict[str, DataFrame]) -> DataFrame:
    """df with ids of another table replaced by their references; an id that the table lacks stays as it is."""
    other = tables.get(table)
    if other is None or "ref" not in other.columns:
        return df
    named = other.select("project_id", F.col(IDS[table]).alias("_id"), F.col("ref").alias("_ref")).dropDuplicates(["project_id", "_id"])
    joined = df.join(named, (df["project_id"] == named["project_id"]) & (df[column] == named["_id"]), "left").drop(named["project_id"])
    return joined.withColumn(column, F.coalesce("_ref", column)).drop("_id", "_ref")


def save(projects: DataFrame, tables: dict[str, DataFrame], path: str) -> None:
    """Writes the projects (project_id, name) and their rows of tables; rows of other projects stay out. An earlier snapshot there is replaced."""
    spark, beside = projects.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    named = projects.select("project_id", F.col("name").alias("project")).dropDuplicates(["project_id"])
    try:
        named.select("project").write.json(f"{beside}/projects")
        for table, df in tables.items():
            told = df
            for column, other in REFERENCES.get(table, {}).items():
                told = _referred(told, column, other, tables)
            if IDS[table] is not None:
                told = (told if "ref" in told.columns else told.withColumn("ref", F.col(IDS[table]))).drop(IDS[table])
            told.join(named, "project_id").drop("project_id").write.partitionBy("project").option("ignoreNullFields", "false").json(f"{beside}/{table}")
        _write_text(spark, f"{beside}/{MANIFEST}", json.dumps({"tables": sorted(tables)}))
        files, at = _files(spark, path)
        files.delete(at, True)
        if not files.rename(_files(spark, beside)[1], at):
            raise OSError(f"cannot move the snapshot to {path}")
    except BaseException:
        files, at = _files(spark, beside)
        files.delete(at, True)
        raise


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """projects (project_id, name) and the tables of a snapshot, each with `ref` where it has an id."""
    files, at = _files(spark, f"{path}/{MANIFEST}")
    if not files.exists(at):
        raise FileNotFoundError(f"no whole snapshot at {path}")
    known = json.loads(spark.read.option("wholetext", True).text(f"{path}/{MANIFEST}").first()[0])["tables"]
    out = {"projects": spark.read.schema("project string").json(f"{path}/projects").select(project_id(F.col("project")).alias("project_id"), F.col("project").alias("name"))}
    for table in known:
        own = IDS[table]
        kept = [f.name for f in spark.createDataFrame([], TABLES[table]).schema.fields if f.name not in ("project_id", own)]
        schema = ", ".join(c for c in _columns(TABLES[table]) if c.split()[0] not in ("project_id", own))
        rows = spark.read.schema(f"{schema}, project string" + (", ref string" if own else "")).json(f"{path}/{table}").withColumn("project_id", project_id(F.col("project")))
        for column, other in REFERENCES.get(table, {}).items():
            rows = rows.withColumn(column, made_id(F.col("project_id"), other, F.col(column)))
        ids = [made_id(F.col("project_id"), table, F.col("ref")).alias(own), "ref"] if own else []
        out[table] = rows.select("project_id", *ids, *kept)
    return out


def _columns(schema: str) -> list[str]:
    """The columns of a schema string, with their types."""
    parts, depth, now = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += ch
    return [*parts, now.strip()]
