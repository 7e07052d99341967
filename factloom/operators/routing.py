"""Routing: what kind of page, table and document it is."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip

#: Limits of pages.
EMPTY_CHARS, IMAGE_CHARS, IMAGE_AREA, RICH_AREA, FEW_DRAWINGS = 15, 25, 0.15, 0.50, 5
TABLE_AREA, TABLE_ROWS, TABLE_COLS, DIGITS, NUMERIC_LINES = 0.30, 4, 3, 0.12, 6
#: Limits of documents.
SCANNED, TEXT_FLOOR, MIXED_RICH, MIXED_TABLES, MIXED_IMAGES, MOSTLY_TABLES = 0.60, 0.40, 0.10, 0.15, 2, 0.5
SLIDES_PAGES, SLIDES_CHARS, SLIDES_ASPECT, LANDSCAPE, ASPECTED = 80, 1600, (1.25, 1.95), 0.8, 0.6
TOOLS = ("powerpoint", "keynote", "impress", "google slides")
#: Limits of tables and of the gate before the table finder.
MIN_ROWS, MIN_COLS, MIN_FILLED, MAX_EMPTY = 2, 2, 4, 0.6
GATE_DIGITS, GATE_LINES, NUMERIC_SHARE = 0.10, 3, 0.2
#: The notes of pages.
NOTES = {
    "empty": "no extractable content",
    "image": "no usable text layer; routed to OCR",
    "tables": " data table(s); structured parse",
    "small": " small table(s) kept alongside prose",
    "skipped": "high numeric density; structured parse skipped (time budget)",
    "incomplete": "high numeric density; structured parse incomplete on this layout",
    "partial": "high numeric density with partial table structure",
    "rich": "image-rich page; text layer still present",
}
#: What led to a profile.
SIGNALS = {
    "tool": "authored in a presentation tool",
    "slides": "landscape slide-aspect pages with low text density",
    "scanned": " of pages have no text layer",
    "prose": "prose with ",
    "tables": " table pages and ",
    "images": " image-rich pages",
    "mostly": "table-dominated with supporting prose",
    "clean": "clean font layer throughout",
    "rich": " image-rich page(s)",
}
NUMERIC = r"[-+]?[\d,]*\.?\d"
WIDE_PAGE = 900
#: Fixed value: the most confidence in what was read by OCR.
OCR_CEILING = 0.6


def digit_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"\P{Nd}+", "")) / F.length(text)).otherwise(F.lit(0.0))


def numeric_lines(text: Column) -> Column:
    """Lines over a fifth of whose characters are digits."""
    share = lambda s: F.length(F.regexp_replace(s, r"\P{Nd}+", "")) > NUMERIC_SHARE * F.length(strip(s))
    return F.size(F.filter(F.split(text, "\n"), lambda s: (strip(s) != "") & share(s)))


def looks_tabular(text: Column) -> Column:
    """Whether the table finder is worth running."""
    gaps = F.size(F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(r"\t|\S {2,}\S"))))
    return (digit_ratio(text) >= GATE_DIGITS) | (gaps >= GATE_LINES)


def reading_order(blocks: Column, width: Column) -> Column:
    """Blocks (x0, y0, text) by column (two on wide pages), then by line, then across."""
    key = lambda b: F.struct(
        F.when((width >= WIDE_PAGE) & (b["x0"] >= width / 2), 1).otherwise(0).alias("column"), F.round(b["y0"], 1).alias("y"), F.round(b["x0"], 1).alias("x"), b["text"].alias("text")
    )
    return F.transform(F.sort_array(F.transform(blocks, key)), lambda b: b["text"])


def page_stats(blocks: Column, width: Column, height: Column) -> Column:
    """image_area_ratio (at most 1) and font_size (the upper median, null without text) of blocks (image, x0, y0, x1, y1, sizes)."""
    area = F.when(width * height == 0, F.lit(1.0)).otherwise(F.abs(width * height))
    covered = F.aggregate(F.filter(blocks, lambda b: b["image"]), F.lit(0.0), lambda s, b: s + F.abs((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])))
    sizes = F.sort_array(F.flatten(F.transform(F.filter(blocks, lambda b: ~b["image"]), lambda b: F.coalesce(b["sizes"], F.array().cast("array<double>")))))
    return F.struct(F.least(covered / area, F.lit(1.0)).alias("image_area_ratio"), F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")).alias("font_size"))


def clean_rows(rows: Column) -> Column:
    """Cells without soft hyphens and line breaks, stripped; blank rows go."""
    cell = lambda c: strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("­"), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))


def is_contents(rows: Column) -> Column:
    """Whether a table is a list of contents: leaders and page numbers behind headings."""
    leads = lambda r: F.element_at(r, -1).rlike(r"^[.…\s]*\d*$")
    head = lambda r: F.array_join(F.slice(r, F.lit(1), F.size(r) - 1), " ")
    n = F.size(F.filter(rows, lambda r: (F.size(r) > 0) & leads(r) & (head(r) != "") & ~head(r).rlike(NUMERIC)))
    return (F.size(rows) >= 4) & (n >= 0.6 * F.size(rows))


def accept_table(rows: Column) -> Column:
    """Whether cleaned rows are a table of data."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: c != ""))
    widest = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    empty = F.when(F.size(cells) > 0, 1 - filled / F.size(cells)).otherwise(F.lit(0.0))
    return (F.size(rows) >= MIN_ROWS) & (widest >= MIN_COLS) & (filled >= MIN_FILLED) & (empty <= MAX_EMPTY) & ~is_contents(rows)


def header_rows(rows: Column) -> Column:
    """1 if the first row has no figure and one of the next two has; else 0."""
    some = lambda r: F.exists(r, lambda c: F.rlike(c, F.lit(NUMERIC)))
    return F.when((F.size(rows) >= 2) & ~some(F.element_at(rows, 1)) & F.exists(F.slice(rows, 2, 2), some), 1).otherwise(0)


def markdown(rows: Column) -> Column:
    """A table as text: ragged rows padded, a rule under the first."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    rule = line(F.array_repeat(F.lit("---"), width))
    lines = F.transform(padded, line)
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def classify_page(page: DataFrame) -> DataFrame:
    """Pages with content_type and notes.

    Columns read: width, height, char_count, image_area_ratio, image_count, drawing_count,
    digit_ratio, numeric_line_count, table_scan_skipped and tables.
    """
    c = F.col
    area = F.when(c("width") * c("height") == 0, 1.0).otherwise(F.abs(c("width") * c("height")))
    covered = F.aggregate("tables", F.lit(0.0), lambda s, t: s + F.abs((t["bbox"]["x1"] - t["bbox"]["x0"]) * (t["bbox"]["y1"] - t["bbox"]["y0"])))
    shape = F.transform("tables", lambda t: F.struct(F.size(t["rows"]).alias("rows"), F.coalesce(F.array_max(F.transform(t["rows"], lambda r: F.size(r))), F.lit(0)).alias("cols")))
    largest = F.aggregate(
        shape, F.struct(F.lit(0).alias("rows"), F.lit(0).alias("cols")), lambda best, s: F.when(s["rows"] * s["cols"] > best["rows"] * best["cols"], s).otherwise(best)
    )
    n = F.size("tables")
    is_empty = (c("char_count") < EMPTY_CHARS) & (c("image_area_ratio") < IMAGE_AREA) & (c("drawing_count") < FEW_DRAWINGS)
    is_image = (c("char_count") < IMAGE_CHARS) & ((c("image_area_ratio") >= IMAGE_AREA) | (c("image_count") >= 1))
    is_table = (n > 0) & ((covered / area >= TABLE_AREA) | ((largest["rows"] >= TABLE_ROWS) & (largest["cols"] >= TABLE_COLS)))
    is_dense = (c("digit_ratio") >= DIGITS) & (c("numeric_line_count") >= NUMERIC_LINES)
    kind = F.when(is_empty, "empty").when(is_image, "image_only").when(is_table | is_dense, "table_heavy").otherwise("text_native")
    small = F.when(n > 0, F.concat(n.cast("string"), F.lit(NOTES["small"])))
    dense = F.when(c("table_scan_skipped"), NOTES["skipped"]).when(n == 0, NOTES["incomplete"]).otherwise(NOTES["partial"])
    notes = (
        F.when(is_empty, F.array(F.lit(NOTES["empty"])))
        .when(is_image, F.array(F.lit(NOTES["image"])))
        .when(is_table, F.array(F.concat(n.cast("string"), F.lit(NOTES["tables"]))))
        .when(is_dense, F.array(small, dense))
        .otherwise(F.array(small, F.when(c("image_area_ratio") >= RICH_AREA, NOTES["rich"])))
    )
    return page.withColumns({"content_type": kind, "notes": F.array_compact(notes)})


def profile(pages: DataFrame) -> DataFrame:
    """A row per document_id from its classified pages: content_type, counts of pages by kind, image_rich, signals.

    Columns read besides: width, height, char_count, image_area_ratio, producer, creator.
    """
    c = F.col
    kinds = {k: F.count_if(c("content_type") == k).alias(f"pages_{k}") for k in ("text_native", "table_heavy", "image_only", "empty")}
    aspect = c("width") / F.greatest(c("height"), F.lit(1.0))
    wide = c("width") > c("height")
    sizes = F.sort_array(F.collect_list("char_count"))
    counted = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"), *kinds.values(), F.count_if(c("image_area_ratio") >= RICH_AREA).alias("image_rich"),
        F.count_if(wide).alias("_wide"), F.count_if(wide & aspect.between(*SLIDES_ASPECT)).alias("_aspect"),
        F.element_at(sizes, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("_median"),
        F.max(F.lower(F.concat_ws(" ", F.coalesce(c("producer"), F.lit("")), F.coalesce(c("creator"), F.lit(""))))).alias("_meta"),
    )
    n = c("page_count")
    tool = F.lit(False)
    for name in TOOLS:
        tool = tool | F.contains(c("_meta"), F.lit(name))
    slides = tool | ((n <= SLIDES_PAGES) & (c("_wide") >= LANDSCAPE * n) & (c("_aspect") >= ASPECTED * n) & (c("_median") < SLIDES_CHARS))
    tables = c("pages_table_heavy") / n
    mixed = (c("pages_text_native") / n >= TEXT_FLOOR) & ((c("image_rich") / n >= MIXED_RICH) | (tables >= MIXED_TABLES) | (c("pages_image_only") >= MIXED_IMAGES))
    kind = (
        F.when(slides, "slides").when(c("pages_image_only") / n >= SCANNED, "scanned").when(mixed, "mixed").when(tables >= MOSTLY_TABLES, "mixed").otherwise("text_native")
    )
    # The product first: 100 * (29 / 200) is less than 14.5.
    share = lambda x: F.concat(F.round(100 * c(x) / n).cast("int").cast("string"), F.lit("%"))
    reason = (
        F.when(tool, SIGNALS["tool"]).when(slides, SIGNALS["slides"]).when(kind == "scanned", F.concat(share("pages_image_only"), F.lit(SIGNALS["scanned"])))
        .when(mixed, F.concat(F.lit(SIGNALS["prose"]), share("pages_table_heavy"), F.lit(SIGNALS["tables"]), share("image_rich"), F.lit(SIGNALS["images"])))
        .when(tables >= MOSTLY_TABLES, SIGNALS["mostly"]).otherwise(SIGNALS["clean"])
    )
    rich = F.when((c("image_rich") > 0) & ~slides, F.concat(c("image_rich").cast("string"), F.lit(SIGNALS["rich"])))
    return counted.withColumns({"content_type": kind, "signals": F.array_compact(F.array(reason, rich))}).drop("_wide", "_aspect", "_median", "_meta")


def document_profile(pages: DataFrame) -> DataFrame:
    """The profile without what led to it."""
    return profile(pages).drop("signals")


def ingest(pages: DataFrame, *, engine: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, profiles, chunks) of documents that are read: pages with their kind, a profile a document, and the chunks.

    pages have what classify_page reads but for the figures of their texts. A chunk of a page without a text
    layer was read by OCR, if there is an engine: its facts are held to a lower confidence.
    """
    from factloom.operators.chunking import build_chunks

    known = classify_page(pages.withColumns({"digit_ratio": digit_ratio(F.col("text")), "numeric_line_count": numeric_lines(F.col("text"))}))
    ceiling = F.when(F.col("content_type") == "image_only", OCR_CEILING).otherwise(1.0)
    return known, profile(known), build_chunks(known).withColumn("confidence_ceiling", ceiling if engine else F.lit(1.0))
