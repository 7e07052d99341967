"""Chunks: pages with their offsets in the document and the context carried over from before."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.text import CARRY_TOKENS, strip, tail

#: Pages and characters of a batch; pages of the first phase; seconds of the budget.
BATCH_PAGES, BATCH_CHARS = 6, 10_000
FAST_PAGES, PHASED_OVER = 20, 30
LEAST_SECONDS, PAGE_SECONDS = 600, 8
CONTEXT_MARK, PAGE_MARK = "[CONTEXT FROM PREVIOUS PAGE]", "[PAGE]"


def build_chunks(pages: DataFrame, *, carry: int = CARRY_TOKENS) -> DataFrame:
    """Kept pages (document_id, page_number, text, content_type) with chunk_index, offsets and leading_context.

    Two characters part the pages. A page that is empty, or blank and not an image, is left out but
    moves the offsets by its unstripped length. Windows are over one document.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    body = strip(raw)
    kept = (F.col("content_type") != "empty") & ((body != "") | (F.col("content_type") == "image_only"))
    order = W.partitionBy("document_id").orderBy("page_number")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    walked = (
        pages.withColumns({"_body": body, "_kept": kept})
        .withColumn("_step", F.when(F.col("_kept"), F.length("_body")).otherwise(F.length(raw)) + 2)
        .withColumn("char_start", F.coalesce(F.sum("_step").over(before), F.lit(0)).cast("int"))
        .withColumn("_last", F.last(F.when(F.col("_kept") & (F.col("_body") != ""), F.col("_body")), ignorenulls=True).over(before))
        .withColumn("chunk_index", (F.sum(F.col("_kept").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    )
    return (
        walked.where("_kept")
        .withColumn("text", F.col("_body"))
        .withColumn("char_end", F.col("char_start") + F.length("_body"))
        .withColumn("leading_context", F.coalesce(tail(F.col("_last"), carry), F.lit("")))
        .drop("_body", "_kept", "_step", "_last")
    )


def prompt_text(leading_context: Column, text: Column) -> Column:
    """A chunk as it is shown to a model."""
    with_context = F.concat(F.lit(CONTEXT_MARK + "\n"), leading_context, F.lit("\n\n" + PAGE_MARK + "\n"), text)
    return F.when(leading_context == "", text).otherwise(with_context)


def plan_batches(chunks: DataFrame) -> DataFrame:
    """chunks with batch: neighbours up to BATCH_PAGES and BATCH_CHARS together; a page with a table alone.

    The fold is over one document's sizes only; texts stay in the JVM. Documents follow each other in a partition, so that
    a short one costs no call of its own and a long one is not held whole.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, batch, pages, chars = object(), -1, 0, 0
        for rows in frames:
            out = []
            for of, size, table in zip(rows["document_id"].tolist(), rows["size"].tolist(), rows["is_table"].tolist()):
                if of != document:
                    document, batch, pages, chars = of, -1, 0, 0
                if table:
                    batch, pages = batch + 1, 0
                else:
                    if not pages or pages >= BATCH_PAGES or chars + size > BATCH_CHARS:
                        batch, pages, chars = batch + 1, 0, 0
                    pages, chars = pages + 1, chars + size
                out.append(batch)
            yield rows[["document_id", "chunk_index"]].assign(batch=out)

    kind = chunks.schema["document_id"].dataType.simpleString()
    light = chunks.select("document_id", "chunk_index", F.length("text").alias("size"), F.coalesce(F.col("table_markdown") != "", F.lit(False)).alias("is_table")).where("document_id IS NOT NULL")
    inside = light.repartition("document_id").sortWithinPartitions("document_id", "chunk_index")
    planned = inside.mapInPandas(fold, f"document_id {kind}, chunk_index int, batch int")
    return chunks.join(planned, ["document_id", "chunk_index"])


def phases(pages: DataFrame) -> DataFrame:
    """pages with phase: 1, or in long documents 1 for the first pages and 2 for the rest."""
    doc = W.partitionBy("document_id")
    place = F.row_number().over(doc.orderBy("page_number"))
    return pages.withColumn("phase", F.when((F.count(F.lit(1)).over(doc) > PHASED_OVER) & (place > FAST_PAGES), 2).otherwise(1))


def budget_seconds(n_pages: Column) -> Column:
    return F.greatest(F.lit(LEAST_SECONDS), PAGE_SECONDS * n_pages)
