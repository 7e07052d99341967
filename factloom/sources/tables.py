"""Where tables come from and go to: Parquet by project, JSON snapshots, files of bytes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schemas import TABLES
from factloom.scope import Scope


def read_table(spark: SparkSession, store: str, name: str, scope: Scope | None = None) -> DataFrame:
    """A table of the store; with a scope only its project's partition is read."""
    df = spark.read.schema(TABLES[name]).parquet(f"{store}/{name}")
    return df if scope is None else scope.table(df)


def write_table(df: DataFrame, store: str, name: str, mode: str = "append") -> None:
    """Writes by project; `overwrite` replaces the projects that df has and no others."""
    out = df.write.partitionBy("project_id").mode(mode)
    if mode == "overwrite":
        out = out.option("partitionOverwriteMode", "dynamic")
    out.parquet(f"{store}/{name}")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of files; what intake judges."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of JSON snapshots: one object per file, with the project's name and an array per table.

    Symbolic references become ids: a hash of project, table and reference, the same in every run.
    """
    arrays = ", ".join(f"{name}: array<map<string,string>>" for name in ("documents", "facts", "relationships", "concepts"))
    raw = spark.read.schema(f"project struct<name:string>, {arrays.replace(': ', ' ')}").option("multiLine", True).json(path)
    top = raw.withColumn("project_id", F.sha2(F.concat(F.lit("project:"), "project.name"), 256))
    out = {"projects": top.select("project_id", F.col("project.name").alias("name"))}
    for name in ("documents", "facts", "relationships", "concepts"):
        out[name] = top.select("project_id", F.explode(name).alias("row")).withColumn("id", F.sha2(F.concat_ws(":", "project_id", F.lit(name), F.col("row")["ref"]), 256))
    return out


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
