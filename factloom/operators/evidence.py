"""The evidence view: where a fact's evidence stands on its page, as boxes, one for each line that it touches.

A page is one row of words with their boxes, as a reader of page layouts gives them (words that come as rows are gathered). The words
of a page, joined by single blanks in their order, are its text. A span is looked for in that text, whatever its case and blanks;
the blanks before each of its places tell which words it touches, and their boxes are merged by line. All that is done where the
page and its facts meet: no word moves by itself, and no page is compared with the facts of another.

The span that a fact was anchored to is looked for first; if the page does not have it, the beginning of the evidence is. A fact
without either, or whose page has no words, has no boxes.
"""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.functions.render import relative_boxes
from factloom.functions.text import WHITE, strip

#: Fixed value: characters of the evidence that are looked for where its anchor is not found.
LOOKED_FOR = 80
PAGE = ["document_id", "page_number"]
WORD = ("place", "line", "word", "x0", "y0", "x1", "y1")
#: What stands between words where they are counted.
MARK = "\u0001"


def plain(text: Column) -> Column:
    """Lower case, single blanks, none at the ends."""
    return F.lower(strip(F.regexp_replace(text, r"\s+", " ")))


def paged(words: DataFrame) -> DataFrame:
    """document_id, page_number, words: the words of each page in one row, in their order.

    words are rows (document_id, page_number, place, line, word, x0, y0, x1, y1), or are such pages already.
    """
    if "words" in words.columns:
        return words
    return words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*WORD))).alias("words"))


def places(text: Column, span: Column) -> Column:
    """Where a span begins in a text, each time that it stands there, from the left and without overlaps."""
    mark = F.lit("\u0001")
    pieces = F.split(F.replace(text, span, mark), mark)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(span)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out"))
    return F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["out"])


def _is_odd(text: Column) -> Column:
    """Whether any of the words of a text, with MARK between them, is blank or holds a blank. Many plain searches are cheaper than one by a pattern."""
    return functools.reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in (f"{MARK}{MARK}", *WHITE)], F.startswith(text, F.lit(MARK)) | F.endswith(text, F.lit(MARK)) | (text == ""))


def _touched(words: Column, text: Column, begin: Column, length: Column) -> Column:
    """The words that a span of a text touches; the text is that of words with MARK between them, and the span begins and ends in words."""
    marks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(MARK), F.lit("")))
    return F.slice(words, marks(F.substring(text, F.lit(1), begin)) + 1, marks(F.substring(text, begin + 1, length)) + 1)


def _by_line(words: Column) -> Column:
    """A box for each line of words, in reading order."""

    def box(line: Column) -> Column:
        of = lambda name, ws: F.transform(ws, lambda w: w[name])
        merged = lambda ws: F.struct(F.array_min(of("x0", ws)).alias("x0"), F.array_min(of("y0", ws)).alias("y0"), F.array_max(of("x1", ws)).alias("x1"), F.array_max(of("y1", ws)).alias("y1"))
        return let(F.filter(words, lambda w: w["line"].eqNullSafe(line)), merged)

    return F.transform(F.array_distinct(F.transform(words, lambda w: w["line"])), box)


def _boxes(words: Column, anchor: Column, evidence: Column) -> Column:
    """The boxes of a fact on a page: of its anchor, or else of its evidence; null without either."""
    told = lambda ws: F.array_join(F.transform(ws, lambda w: w["word"]), MARK)
    marks = lambda ws, text: F.size(ws) == F.length(F.replace(text, F.lit(MARK), F.lit(f"{MARK}{MARK}"))) - F.length(text) + 1
    form = lambda w: w.withField("word", F.translate(plain(w["word"]), MARK, "\u0002"))
    formed = lambda ws: F.struct(ws.alias("words"), told(ws).alias("marked"))
    # Most pages have neither blank words nor blanks in words: these are made plain at once, others word by word.
    slow = let(F.transform(F.filter(words, lambda w: strip(w["word"]) != ""), form), formed)
    laid = let(told(words), lambda t: F.when(marks(words, t) & ~_is_odd(t), F.struct(words.alias("words"), F.lower(t).alias("marked"))).otherwise(slow))
    said = lambda p: F.struct(p["words"].alias("words"), p["marked"].alias("marked"), F.replace(p["marked"], F.lit(MARK), F.lit(" ")).alias("text"), anchor.alias("anchor"), evidence.alias("evidence"))
    has = lambda p, s: (p[s] != "") & F.contains(p["text"], p[s])
    sought = lambda p: F.when(has(p, "anchor"), p["anchor"]).when(has(p, "evidence"), p["evidence"])

    def found(p: Column, span: Column) -> Column:
        return F.flatten(F.transform(places(p["text"], span), lambda at: let(_touched(p["words"], p["marked"], at, F.length(span)), _by_line)))

    return let(let(laid, said), lambda p: let(sought(p), lambda span: found(p, span)))


def boxes(facts: DataFrame, words: DataFrame) -> DataFrame:
    """fact_id, document_id, page_number, boxes: of each fact with evidence on its page, a box for each line of each place, in reading order.

    facts are (fact_id, document_id, page_number, matched_text, evidence_text), words what `paged` takes.
    """
    anchor, evidence = plain(F.coalesce("matched_text", "evidence_text", F.lit(""))), plain(F.substring(F.coalesce("evidence_text", F.lit("")), 1, LOOKED_FOR))
    unmarked = lambda t: F.translate(t, MARK, "\u0002")
    asked = facts.select("fact_id", *PAGE, unmarked(anchor).alias("anchor"), unmarked(evidence).alias("evidence"))
    # Facts are shorter than their pages: these are not sorted.
    met = paged(words).join(asked.hint("shuffle_hash"), PAGE)
    found = F.filter(F.array(_boxes(F.col("words"), F.col("anchor"), F.col("evidence"))), lambda b: F.size(b) > 0)
    return met.select("fact_id", *PAGE, F.explode(found).alias("boxes"))


def view(facts: DataFrame, documents: DataFrame, chunks: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """facts with filename, surrounding_text, width and height of the page, boxes, and these as shares of the page.

    facts are (fact_id, document_id, chunk_index, page_number, matched_text, evidence_text), pages (document_id, page_number, width,
    height). The surrounding text is that of the fact's chunk, or else the evidence.
    """
    named = facts.join(documents.select("document_id", "filename"), "document_id", "left")
    told = named.join(chunks.select("document_id", "chunk_index", F.col("text").alias("_text")), ["document_id", "chunk_index"], "left")
    sized = told.join(pages.select(*PAGE, "width", "height"), PAGE, "left").join(boxes(facts, words).select("fact_id", "boxes"), "fact_id", "left")
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    box = F.coalesce(F.col("boxes").cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"), none)
    return sized.select(
        "fact_id", "document_id", F.coalesce("filename", F.lit("document.pdf")).alias("filename"), "page_number", "evidence_text", F.coalesce("_text", "evidence_text").alias("surrounding_text"),
        F.col("width").alias("page_width"), F.col("height").alias("page_height"), box.alias("boxes"), relative_boxes(box, F.col("width"), F.col("height")).alias("relative_boxes"),
    )
