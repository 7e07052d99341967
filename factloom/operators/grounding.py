"""Grounding and anchoring of evidence in the text that it is said to be from."""

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions.binding import let
from factloom.functions.text import ANCHORING_FROM, ANCHORING_TO, GROUNDING_DROPPED, GROUNDING_FROM, GROUNDING_TO, alnum_count, anchoring_form, grounding, grounding_form
from factloom.sources.shared import durable

#: When a span between the first and the last word still counts as the evidence.
SPAN_WORDS, SPAN_TIMES, SPAN_LEAST = 3, 3, 200
PLAIN = str.maketrans(ANCHORING_FROM, ANCHORING_TO)
GROUNDED = str.maketrans(GROUNDING_FROM, GROUNDING_TO)
GONE = re.compile(rf"-[ \t]*\n[ \t]*|[{GROUNDING_DROPPED}]")
WORD = re.compile(r"\S+")
#: Words from the second to the fifth of an evidence text; they stand as whole words wherever it is found.
KEY_WORDS = 4
#: Characters that the keys of shorter texts are made from; a text has the longest that it can.
KEY_CHARS = (16, 8, 4)
#: Fixed value: the least letters and digits of a text that can be grounded.
LEAST_ALNUM = 4
#: Up to so many rows of some dozen bytes are broadcast; above, they are joined by a shuffle.
MOST_BROADCAST = 200_000


def _form(text: str, plain: dict = PLAIN, gone: re.Pattern | None = None) -> tuple[str, Sequence[int]]:
    """A text with plain characters, collapsed and lower-cased, without what is gone; and where each character was.

    Word by word; a text that loses characters, or whose lower case is another with its neighbours or its length, character by character.
    """
    if gone is None or not gone.search(text):
        made = text if text.isascii() else text.translate(plain)
        low = made.lower()
        if len(low) == len(made) and "Σ" not in made:
            if (form := " ".join(low.split())) == low:
                return low, range(len(low))
            at = []
            for m in WORD.finditer(low):
                at.extend(range(m.start() - bool(at), m.end()))
            return form, at
    return _form_by_character(text, plain, gone)


def _form_by_character(text: str, plain: dict, gone: re.Pattern | None) -> tuple[str, list[int]]:
    out, at, gap = [], [], False
    skipped = {i for m in gone.finditer(text) for i in range(*m.span())} if gone else ()
    for i, ch in enumerate(text):
        if i in skipped:
            continue
        if ch.translate(plain).isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(" ")
            at.append(i - 1)
            gap = False
        for low in ch.translate(plain).lower():
            out.append(low)
            at.append(i)
    return "".join(out), at


def _locate(evidence: str | None, text: str | None) -> tuple[int, int] | None:
    """Where the evidence is found when it isn't there letter by letter: by form, then from first to last word."""
    if not evidence or not evidence.strip() or not text:
        return None
    (e, _), (t, at) = _form(evidence), _form(text)
    k = t.find(e)
    if k >= 0:
        return at[k], at[k + len(e) - 1] + 1
    words = e.split()
    if len(words) >= SPAN_WORDS:
        # from the first place of the first word to the last place of the last one
        a, b = t.find(words[0]), t.rfind(words[-1])
        if 0 <= a <= b:
            start, end = at[a], at[b + len(words[-1]) - 1] + 1
            if end - start <= max(SPAN_TIMES * len(evidence), SPAN_LEAST):
                return start, end
    return None


def anchor(rows: DataFrame) -> DataFrame:
    """rows (evidence_text, text, char_start) with anchor_start, anchor_end (in the document) and exact.

    Rows are read once. Literal finds stay in the JVM; only the texts of the others go through Arrow.
    """
    here = F.instr(F.col("text"), F.col("evidence_text"))
    blank = F.trim(F.coalesce(F.col("evidence_text"), F.lit(""))) == ""
    found = rows.withColumn("_at", F.when(~blank, F.coalesce(here, F.lit(0))).otherwise(F.lit(0)))

    @F.pandas_udf("struct<a:int,b:int>")
    def fuzzy(evidence: pd.Series, text: pd.Series) -> pd.DataFrame:
        spans = [_locate(e, t) or (None, None) for e, t in zip(evidence, text)]
        return pd.DataFrame({"a": pd.array([s[0] for s in spans], "Int32"), "b": pd.array([s[1] for s in spans], "Int32")})

    literal, start = F.col("_at") > 0, F.coalesce(F.col("char_start"), F.lit(0))
    other = lambda c: F.when(~literal, F.col(c))
    placed = found.withColumn("_s", fuzzy(other("evidence_text"), other("text")))
    return placed.withColumns(
        {
            "anchor_start": (start + F.when(literal, F.col("_at") - 1).otherwise(F.col("_s.a"))).cast("int"),
            "anchor_end": (start + F.when(literal, F.col("_at") - 1 + F.length("evidence_text")).otherwise(F.col("_s.b"))).cast("int"),
            "exact": F.when(literal, True).when(F.col("_s.a").isNotNull(), False),
        }
    ).drop("_at", "_s")


def _grounded_at(evidence: str | None, text: str | None) -> tuple[int, int] | None:
    """Where in the raw text the grounding form of the evidence first stands."""
    e, (t, at) = _form(evidence or "", GROUNDED, GONE)[0], _form(text or "", GROUNDED, GONE)
    k = t.find(e) if e else -1
    return (at[k], at[k + len(e) - 1] + 1) if k >= 0 else None


def ground(rows: DataFrame) -> DataFrame:
    """rows (evidence_text, text) with passed, reason, and matched_start and matched_end in the raw text.

    Rows are read once. The rules stay in the JVM; only the texts of what passes go through Arrow for its place.
    """

    @F.pandas_udf("struct<a:int,b:int>")
    def places(evidence: pd.Series, text: pd.Series) -> pd.DataFrame:
        spans = [_grounded_at(e, t) or (None, None) for e, t in zip(evidence, text)]
        return pd.DataFrame({"a": pd.array([s[0] for s in spans], "Int32"), "b": pd.array([s[1] for s in spans], "Int32")})

    judged = rows.withColumn("_g", grounding(F.col("evidence_text"), F.col("text"))).withColumns({"passed": F.col("_g.passed"), "reason": F.col("_g.reason")}).drop("_g")
    good = lambda c: F.when(F.col("passed"), F.col(c))
    return judged.withColumn("_s", places(good("evidence_text"), good("text"))).withColumns({"matched_start": F.col("_s.a"), "matched_end": F.col("_s.b")}).drop("_s")


def batch_chunk(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """facts (fact_id, document_id, batch, source_page, evidence_text) with chunk_index, the chunk of their batch that they are from.

    That is the chunk of the stated page; else the first one that holds the evidence, letter by letter or by
    its anchoring form; else the batch's first. A batch is a few chunks by its definition.
    """
    places = chunks.select("document_id", "batch", "chunk_index", "page_number", F.col("text").alias("_text"))
    evidence = F.trim(F.coalesce(F.col("evidence_text"), F.lit("")))
    held = (evidence != "") & (F.contains("_text", evidence) | F.contains(anchoring_form(F.col("_text")), anchoring_form(evidence)))
    order = F.struct(F.when(F.col("source_page") == F.col("page_number"), 0).when(F.coalesce(held, F.lit(False)), 1).otherwise(2).alias("kind"), F.col("chunk_index"))
    found = facts.join(places, ["document_id", "batch"]).groupBy("fact_id").agg(F.min(order)["chunk_index"].alias("chunk_index"))
    return facts.join(found, "fact_id", "left")


def _checked(df: DataFrame) -> DataFrame:
    """The frame, written once; marked for broadcast if its rows are few."""
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def _windows(form: Column, kind: int) -> Column:
    """Hashes of all windows of a grounding form: of KEY_WORDS words (kind 0), or of that many characters."""
    size = KEY_WORDS if kind == 0 else kind

    def hashed(units: Column) -> Column:
        many = F.size(units) - size + 1
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.xxhash64(F.slice(units, i, F.lit(size))))
        return F.when(many > 0, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))

    # Bound, as the form would otherwise be made anew for each window.
    return let(F.split(form, " " if kind == 0 else ""), hashed)


def find_passages(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id of the passages that are grounded in a document.

    A passage is looked for only where its key stands: four inner words in a row, or for one of fewer
    than six words its first 16, 8 or 4 characters. Documents' windows meet the keys in a join; few keys, as of
    a benchmark, are broadcast, so that no window moves, and so are the few pairs that are left to
    confirm, so that no text does.
    """
    items = passages.select("item_id", F.col("text").alias("_passage"), grounding_form(F.coalesce("text", F.lit(""))).alias("_form")).where(alnum_count(F.col("_form")) >= LEAST_ALNUM)
    words = F.split("_form", " ")
    kind = F.when(F.size(words) >= KEY_WORDS + 2, 0)
    for n in KEY_CHARS:
        kind = kind.when(F.length("_form") >= n, n)
    first = F.xxhash64(F.slice(words, 2, KEY_WORDS))
    for n in KEY_CHARS:
        first = F.when(F.col("_kind") == n, F.xxhash64(F.slice(F.split("_form", ""), 1, n))).otherwise(first)
    keyed = _checked(items.withColumn("_kind", kind).select("item_id", "_kind", first.alias("_key")))
    kinds = sorted(r["_kind"] for r in keyed.select("_kind").distinct().collect())
    form = grounding_form(F.coalesce("text", F.lit("")))
    found = documents.sparkSession.createDataFrame([], StructType([documents.schema["doc_id"], passages.schema["item_id"]]))
    for k in kinds:
        windows = documents.select("doc_id", F.explode(_windows(form, k)).alias("_key"))
        found = found.union(windows.join(keyed.where(F.col("_kind") == k), "_key").select("doc_id", "item_id"))
    pairs = _checked(found.distinct())
    checked = documents.select("doc_id", F.col("text").alias("_text")).join(pairs, "doc_id").join(items.select("item_id", "_passage"), "item_id")
    return checked.where(grounding(F.col("_passage"), F.col("_text"))["passed"]).select("item_id", "doc_id")
