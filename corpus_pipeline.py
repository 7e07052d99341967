"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last the packed
pieces. What a stage returns is written as Parquet in the folder of spark.checkpoint.dir and read
again, so a lost executor costs no more than its part of one stage. A stage's folder goes once the
next one is written; that of the last stays, as the result reads it.

Defined results, in every stage: any column may be null; a null or empty text is a text without
words; rows may repeat or tie; texts may be very long; no rows give no rows; columns besides those
of documents are left out, whatever their names. Each stage's docstring says what that comes to.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import dedup, mixing, packing, quality, secrets
from factloom.llm.common import durable
from factloom.llm.queries import tokenizer_file, trusted_ids
from factloom.sources.shared import remove_folder, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle.
SHINGLE = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or score under the threshold, go.

    A null or empty text fails them. Repeated rows are judged each; a score that ties with the
    threshold stays. Without trusted documents only the base rules reject.
    """
    weights, threshold = quality.fit(docs, trusted_ids(spark, sf_dir))
    return quality.judge(docs.select(*COLUMNS), weights, threshold=threshold).where("kept").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays.

    A row that is repeated (id and text) stays once. Different texts of one id are one document: each
    goes if it is alike to a smaller id's, else it stays. Texts without words, and rows without an id, are alike to nothing and stay.
    """
    held = docs.select(*COLUMNS)
    near = durable(dedup.near_rows(held, size=SHINGLE))
    return dedup.one_of_each(held, near, SHINGLE)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes.

    A null text stays null. n_chars changes with the text only. Repeated rows stay repeated.
    """
    model = secrets.train(secrets.labelled_samples(spark))
    clean = secrets.redact(secrets.scan(docs.select(*COLUMNS), model))
    changed = F.size("secrets") > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is seen once at least; those of small sources up to twice, as rows of their own.

    A null source is a source; a null or empty text counts as one token; repeated rows are documents of their own.
    """
    return mixing.mix(docs.select(*COLUMNS), max_repetition=2.0).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their places in sequences.

    A null or empty text is the end id alone; repeated rows are documents of their own.
    """
    return packing.pack(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The models of the stages are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole documents table."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{at}/{name}"
    return docs
