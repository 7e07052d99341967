"""Project profiles as a stream: documents are folded in as they arrive, and the state of a project lives between batches.

The state is the centres and sizes of the project's clusters, the centre of all its documents, and their number; its size
is that of the clusters, whatever the number of documents. Documents and terms that came before are dropped by Spark's own keyed
deduplication, whose state is spread over all tasks. With one checkpoint folder a restart goes on where the stream stopped, and
the file sink shows each batch once, so nothing is folded twice.

In a batch the documents of a project are folded in the order of created_at, then document_id; so batches that come in the order of
their documents give what one batch gives. A task holds the documents of one project of one batch; batches are
bounded by the source (maxFilesPerTrigger). Documents without a project or an embedding, or with a null in it, take no part.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.clusters import JOIN, Fold

STATE = "centres array<double>, sizes array<int>, whole array<double>, documents int"
PROFILE = "document_count int, centre array<double>, sizes array<int>, centres array<array<double>>"


def placements(documents: DataFrame, *, join: float = JOIN) -> DataFrame:
    """document_id, sub_cluster_id, similarity, off_domain of each new document of a stream (project_id, document_id, created_at, doc_embedding).

    The last document of a project in a batch has `profile` too, the project's profile after it; place tells the order.
    """
    kinds = dict(documents.dtypes)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["created_at", "document_id"], kind="stable")
        length = len(rows["doc_embedding"].iat[0])
        flat, sizes, whole, n = state.get if state.exists else ([], [], [], 0)
        clusters = Fold(np.array(flat, float).reshape(-1, length).tolist() if len(flat) else None, [int(s) for s in sizes], join)
        everything = Fold([list(whole)], [n], -2.0) if n else Fold(join=-2.0)  # at -2 everything joins the first cluster
        out = []
        for e in rows["doc_embedding"]:
            out.append(clusters.add(e))
            everything.add(e)
        n += len(rows)
        centres = [c.tolist() for c in clusters.centres]
        state.update(([x for c in centres for x in c], clusters.sizes, everything.centres[0].tolist(), n))
        profile = {"document_count": n, "centre": everything.centres[0].tolist(), "sizes": clusters.sizes, "centres": centres}
        yield pd.DataFrame(
            {
                "project_id": key[0], "document_id": rows["document_id"].to_numpy(), "sub_cluster_id": [o[0] for o in out], "similarity": [o[1] for o in out], "off_domain": [o[2] for o in out],
                "place": np.arange(n - len(rows) + 1, n + 1), "profile": [None] * (len(rows) - 1) + [profile],
            }
        )

    whole = F.col("project_id").isNotNull() & (F.size("doc_embedding") > 0) & ~F.exists("doc_embedding", lambda x: x.isNull() | F.isnan(x))
    new = documents.where(whole).select("project_id", "document_id", "created_at", F.col("doc_embedding").cast("array<double>").alias("doc_embedding")).dropDuplicates(["project_id", "document_id"])
    schema = f"project_id {kinds['project_id']}, document_id {kinds['document_id']}, sub_cluster_id string, similarity double, off_domain boolean, place int, profile struct<{PROFILE.replace(' ', ':').replace(',:', ',')}>"
    return new.groupBy("project_id").applyInPandasWithState(fold, schema, STATE, "append", "NoTimeout")


def new_terms(facts: DataFrame) -> DataFrame:
    """project_id, term, document_id: each distinct entity of a stream (project_id, document_id, entity), once."""
    named = facts.where(F.trim("entity") != "").select("project_id", F.trim("entity").alias("term"), "document_id")
    return named.dropDuplicates(["project_id", "term"])


def run(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Takes in all that has arrived; the rows of each batch are added to the store, once."""
    stream.writeStream.format("parquet").outputMode("append").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(placed: DataFrame) -> DataFrame:
    """project_id and the profile of each project after its last batch; placed is what a store holds."""
    last = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("place")))
    return placed.where("profile IS NOT NULL").withColumn("_n", last).where("_n = 1").select("project_id", "profile.*")
