"""Isolation: every read of a project's rows starts with its id."""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


@dataclass(frozen=True)
class Scope:
    """The rows of one project; on tables partitioned by project_id the filter prunes partitions."""

    project_id: str

    def __post_init__(self):
        if not UUID.fullmatch(self.project_id):
            raise ValueError(f"not a project id: {self.project_id!r}")

    def table(self, df: DataFrame) -> DataFrame:
        if "project_id" not in df.columns:
            raise ValueError("the table has no project_id")
        return df.where(F.col("project_id") == self.project_id)
