"""Clusters: documents join the nearest cluster of their project in the order in which they arrive.

The fold depends on that order, so a project's documents are read one after the other, sorted by
Spark and in batches; what is held of a project is its clusters' centres and sizes. Streams keep the
same state between batches.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the similarity from which a document joins a cluster.
JOIN = 0.70


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum())
    return v / n if n else v


class Fold:
    """Centres (of length one) and sizes of one project's clusters."""

    def __init__(self, centres: list | None = None, sizes: list | None = None, join: float = JOIN):
        self.sizes, self.join = list(sizes or []), join
        self.table = np.array([_unit(np.asarray(c, float)) for c in centres], float) if centres else np.zeros((0, 0))

    @property
    def centres(self) -> list[np.ndarray]:
        return list(self.table[: len(self.sizes)])

    def add(self, embedding) -> tuple[str, float, bool]:
        """Cluster, similarity and whether the document is off the project's domain."""
        v, n = np.asarray(embedding, float), len(self.sizes)
        near = self.table[:n] @ _unit(v) if n else np.zeros(0)
        k = int(near.argmax()) if n else -1
        if n and near[k] >= self.join:
            self.table[k] = _unit((self.table[k] * self.sizes[k] + v) / (self.sizes[k] + 1))
            self.sizes[k] += 1
            return f"sc_{k + 1}", float(near[k]), False
        if n == len(self.table):
            grown = np.zeros((max(8, 2 * n), len(v)))
            if n:
                grown[:n] = self.table
            self.table = grown
        self.table[n] = _unit(v)
        self.sizes.append(1)
        return f"sc_{n + 1}", float(near[k]) if n else 1.0, bool(n)


def assign(documents: DataFrame, *, join: float = JOIN) -> DataFrame:
    """project_id, document_id, sub_cluster_id, similarity, off_domain; a document counts once."""
    kinds = dict(documents.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, state = None, Fold(join=join)
        for rows in frames:
            out = []
            for p, e in zip(rows["project_id"], rows["doc_embedding"]):
                if p != project:
                    project, state = p, Fold(join=join)
                out.append(state.add(e))
            yield rows[["project_id", "document_id"]].assign(sub_cluster_id=[o[0] for o in out], similarity=[o[1] for o in out], off_domain=[o[2] for o in out])

    once = documents.where("doc_embedding IS NOT NULL AND project_id IS NOT NULL").select("project_id", "document_id", "created_at", "doc_embedding").dropDuplicates(["project_id", "document_id"])
    return once.repartition("project_id").sortWithinPartitions("project_id", "created_at", "document_id").mapInPandas(
        fold, f"project_id {kinds['project_id']}, document_id {kinds['document_id']}, sub_cluster_id string, similarity double, off_domain boolean"
    )


def mean_embedding(chunks: DataFrame, *, first: int = 48) -> DataFrame:
    """document_id, doc_embedding: the mean of the first chunks' embeddings, of length one (zeros stay zeros)."""
    means = (
        chunks.where(F.col("chunk_index") < first)
        .select("document_id", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("document_id", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    )
    vector = F.transform("v", lambda e: e["x"])
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return means.select("document_id", F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(vector).alias("doc_embedding"))


def profiles(documents: DataFrame, *, join: float = JOIN) -> DataFrame:
    """project_id, document_count, centre, clusters: each project after its documents have been folded in, in the order of their arrival.

    centre is the running mean of all documents' embeddings, of length one; clusters are id, size, centre and document_ids.
    """
    kinds = dict(documents.dtypes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state, whole, members = Fold(join=join), Fold(join=-2.0), {}  # at -2 everything joins the first cluster
        rows = rows.sort_values(["created_at", "document_id"])
        for doc, e in zip(rows["document_id"], rows["doc_embedding"]):
            members.setdefault(state.add(e)[0], []).append(doc)
            whole.add(e)
        found = [{"id": f"sc_{k + 1}", "size": n, "centre": c.tolist(), "document_ids": members[f"sc_{k + 1}"]} for k, (c, n) in enumerate(zip(state.centres, state.sizes))]
        return pd.DataFrame({"project_id": rows["project_id"].iloc[:1], "document_count": len(rows), "centre": [whole.centres[0].tolist()], "clusters": [found]})

    once = documents.where("doc_embedding IS NOT NULL").select("project_id", "document_id", "created_at", "doc_embedding").dropDuplicates(["project_id", "document_id"])
    cluster = f"struct<id:string,size:int,centre:array<double>,document_ids:array<{kinds['document_id']}>>"
    return once.groupBy("project_id").applyInPandas(fold, f"project_id {kinds['project_id']}, document_count int, centre array<double>, clusters array<{cluster}>")


def vocabulary(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """project_id, term, document_id, created_at: each project's distinct entities by the document that showed them first."""
    seen = facts.where(F.trim("entity") != "").select("document_id", F.trim("entity").alias("term")).distinct()
    first = seen.join(documents.select("project_id", "document_id", "created_at"), "document_id").groupBy("project_id", "term").agg(F.min(F.struct("created_at", "document_id")).alias("f"))
    return first.select("project_id", "term", F.col("f.document_id").alias("document_id"), F.col("f.created_at").alias("created_at"))
