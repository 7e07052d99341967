"""The folder that the driver and all executors share, for what is written between jobs."""

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _temporary(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one temporary folder an application, on one machine only.

    On a cluster a temporary folder would be another one on each machine, so there an unset
    folder is an error.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _temporary(sc.applicationId)


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """The frame cut off from its lineage, kept where every executor can read it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
