"""Tables found on pages of words with boxes: columns from the gaps that lines share, rows from the space between lines.

1. The words of a line fall into cells where the gap between them is wide.
2. Lines of several cells that follow each other, with single cells next to them or behind their left edge, are a run.
3. The cells of a run, laid over each other, leave gaps that no line fills: what lies between two gaps is a column.
4. Lines that are set closer than the run's rows are one row: the lines of a cell that was broken.
5. A run of two rows and two columns at least is a table. Whether it is one of data, `routing.accept_table` tells.

A page's words are few and pages never meet, so a page is one row: its words are gathered once, and all that follows are functions of
that array, without a shuffle or a sort of rows. Words are (document_id, page_number, place, line, word, x0, y0, x1, y1); blank words
and words without a box are left out. A single cell at the edge of a run is a row only if it stands behind the first column, and
nowhere if it lies over several columns.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.binding import let

#: Shares of a line's height: the least gap between cells, the gap between lines that ends a run, and that between rows, at least.
CELL_GAP, RUN_GAP, ROW_GAP = 1.0, 4.0, 0.25
PAGE = ["document_id", "page_number"]


def _pieces(items: Column, new: Callable[[Column], Column]) -> Column:
    """An array cut before each item, by its place from 0, at which a piece begins; the first always begins one."""
    places = F.filter(F.transform(items, lambda _, i: i), lambda i: (i == 0) | F.coalesce(new(i), F.lit(False)))
    return let(places, lambda at: F.transform(at, lambda a, j: F.slice(items, a + 1, F.coalesce(F.get(at, j + 1), F.size(items)) - a)))


def _tops(values: Column) -> Column:
    """For each of some figures the largest before it; null for the first."""
    start = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, x: F.struct(F.greatest(acc["top"], x).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def _line(words: Column, gap: float) -> Column:
    """A line with its cells, from its words from the left."""

    def cell(ws: Column) -> Column:
        return F.struct(
            F.array_join(ws["w"], " ").alias("text"), F.array_min(ws["x0"]).alias("x0"), F.array_min(ws["y0"]).alias("y0"), F.array_max(ws["x1"]).alias("x1"), F.array_max(ws["y1"]).alias("y1")
        )

    def apart(tops: Column, i: Column) -> Column:
        w = F.get(words, i)
        return w["x0"] - F.get(tops, i) > gap * (w["y1"] - w["y0"])

    cells = let(_tops(words["x1"]), lambda tops: F.transform(_pieces(words, lambda i: apart(tops, i)), cell))
    return let(
        cells,
        lambda c: F.struct(
            F.array_min(c["y0"]).alias("y0"), F.get(words, 0)["line"].alias("line"), F.array_max(c["y1"]).alias("y1"), F.array_min(c["x0"]).alias("x0"), (F.size(c) > 1).alias("many"), c.alias("cells")
        ),
    )


def _runs(lines: Column) -> Column:
    """Runs of a page's lines, which come down the page; each line with space, that to the line before it."""

    def marked(first: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            before, after = F.get(lines, i - 1), F.get(lines, i + 1)
            # A single cell that stands to the right of where the page's lines of several cells begin is in a column of its own.
            behind = F.coalesce(x["x0"] > first + (x["y1"] - x["y0"]), F.lit(False))
            belongs = x["many"] | F.coalesce(before["many"], F.lit(False)) | F.coalesce(after["many"], F.lit(False)) | behind
            return F.struct(*[x[c].alias(c) for c in ("y0", "line", "y1", "many", "cells")], belongs.alias("belongs"), (x["y0"] - before["y1"]).alias("space"))

        return F.transform(lines, mark)

    def cut(all_: Column) -> Column:
        def new(i: Column) -> Column:
            x = F.get(all_, i)
            return ~F.get(all_, i - 1)["belongs"] | (x["space"] > RUN_GAP * (x["y1"] - x["y0"]))

        return F.filter(F.transform(_pieces(all_, new), lambda r: F.filter(r, lambda x: x["belongs"])), lambda r: F.size(r) > 0)

    first = F.array_min(F.filter(lines, lambda x: x["many"])["x0"])
    return let(let(first, marked), cut)


def _placed(run: Column) -> Column:
    """The cells of a run, each with its row, line and place in the line."""

    def rows(widest: Column) -> Column:
        def new(i: Column) -> Column:
            x = F.get(run, i)
            high = x["y1"] - x["y0"]
            return ~F.coalesce((widest >= ROW_GAP * high) & (x["space"] < widest / 2) & (x["space"] < ROW_GAP * high), F.lit(False))

        return _pieces(run, new)

    def cell(x: Column, k: Column, line: Column, row: Column) -> Column:
        return F.struct((row + 1).alias("row"), x["y0"].alias("y0"), line["line"].alias("line"), k.alias("cell"), x["text"].alias("text"), x["x0"].alias("x0"), x["x1"].alias("x1"), x["y1"].alias("y1"), line["many"].alias("many"))

    # The space before a run's first line is none of the run's.
    widest = F.array_max(F.slice(run["space"], 2, F.size(run)))
    in_row = lambda ls, row: F.flatten(F.transform(ls, lambda line: F.transform(line["cells"], lambda x, k: cell(x, k, line, row))))
    return F.flatten(F.transform(let(widest, rows), in_row))


def _columns(cells: Column) -> Column:
    """left and right of each column of a run: what the cells of lines with several cells cover together."""
    across = F.sort_array(F.transform(F.filter(cells, lambda x: x["many"]), lambda x: F.struct(x["x0"].alias("x0"), x["x1"].alias("x1"))))

    def merged(boxes: Column) -> Column:
        cut = let(_tops(boxes["x1"]), lambda tops: _pieces(boxes, lambda i: ~F.coalesce(F.get(boxes, i)["x0"] <= F.get(tops, i), F.lit(False))))
        return F.transform(cut, lambda p: F.struct(F.array_min(p["x0"]).alias("left"), F.array_max(p["x1"]).alias("right")))

    return let(across, merged)


def _table(cells: Column, number: Column) -> Column:
    """A run's cells as a table: y0, run, rows and the other sides of its box; wide is its number of columns."""

    def own(columns: Column) -> Column:
        over = lambda x: F.filter(F.transform(columns, lambda c, j: F.when((x["x0"] < c["right"]) & (x["x1"] > c["left"]), j + 1)), lambda j: j.isNotNull())
        with_columns = F.transform(cells, lambda x: F.struct(x.alias("x"), over(x).alias("over")))
        return F.transform(F.filter(with_columns, lambda t: F.size(t["over"]) == 1), lambda t: t["x"].withField("column", F.get(t["over"], 0)))

    def inside(mine: Column) -> Column:
        # Single cells before the first line of several cells, or after the last, are no rows of the first column.
        many = F.filter(mine, lambda x: x["many"])["row"]
        edges = F.struct(F.array_min(many).alias("first"), F.array_max(many).alias("last"))
        return let(edges, lambda e: F.filter(mine, lambda x: ((x["row"] >= e["first"]) & (x["row"] <= e["last"])) | (x["column"] > 1)))

    def told(kept: Column) -> Column:
        wide = F.array_max(kept["column"])

        def row(mine: Column) -> Column:
            in_column = lambda j: F.transform(F.filter(mine, lambda x: x["column"] == j), lambda x: F.struct(x["y0"].alias("y0"), x["line"].alias("line"), x["cell"].alias("cell"), x["text"].alias("text")))
            return F.transform(F.sequence(F.lit(1), wide), lambda j: F.array_join(F.sort_array(in_column(j))["text"], " "))

        # A row's cells follow each other.
        rows = F.transform(_pieces(kept, lambda i: F.get(kept, i)["row"] != F.get(kept, i - 1)["row"]), row)
        box = {"x0": F.array_min(kept["x0"]), "x1": F.array_max(kept["x1"]), "y1": F.array_max(kept["y1"])}
        return F.when(wide >= 2, F.struct(F.array_min(kept["y0"]).alias("y0"), number.alias("run"), rows.alias("rows"), *[v.alias(c) for c, v in box.items()]))

    return let(let(let(_columns(cells), own), inside), told)


def tables_of(pages: DataFrame, gap: float = CELL_GAP) -> DataFrame:
    """What find_tables gives, of pages (document_id, page_number, words), one row a page; words are an array of the others' structs."""
    boxed = lambda w: (F.trim(w["word"]) != "") & w["x0"].isNotNull() & w["x1"].isNotNull() & w["y0"].isNotNull() & w["y1"].isNotNull()
    word = lambda w: F.struct(w["line"].alias("line"), w["x0"].cast("double").alias("x0"), w["place"].alias("place"), F.trim(w["word"]).alias("w"), *[w[c].cast("double").alias(c) for c in ("y0", "x1", "y1")])
    lines = lambda ws: F.transform(_pieces(ws, lambda i: ~F.get(ws, i)["line"].eqNullSafe(F.get(ws, i - 1)["line"])), lambda p: _line(p, gap))
    down = let(F.sort_array(F.transform(F.filter("words", boxed), word)), lambda ws: F.sort_array(lines(ws)))
    found = F.transform(let(down, _runs), lambda r, i: let(_placed(r), lambda cells: _table(cells, i)))
    tables = F.sort_array(F.filter(found, lambda t: F.size(t["rows"]) >= 2))
    # Outer, as a filter for pages with tables would be put before the explosion and find all tables twice.
    listed = pages.select(*PAGE, F.posexplode_outer(tables).alias("_at", "_t")).where("_at IS NOT NULL")
    return listed.select(*PAGE, (F.col("_at") + 1).alias("table"), "_t.rows", F.struct("_t.x0", "_t.y0", "_t.x1", "_t.y1").alias("bbox"))


def find_tables(words: DataFrame) -> DataFrame:
    """document_id, page_number, table (from 1, down the page), rows and bbox; what pages of routing call tables."""
    return tables_of(words.groupBy(*PAGE).agg(F.collect_list(F.struct("place", "line", "word", "x0", "y0", "x1", "y1")).alias("words")))
