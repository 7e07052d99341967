"""Lines that show facts, and small repairs of what is shown."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.values import plain_number, show_quantity

#: Signs of comparators where a person reads.
SIGNS = {"approx": "≈ ", "gt": "> ", "gte": "≥ ", "lt": "< ", "lte": "≤ ", "eq": ""}


def shown_value(kind: Column, value: Column) -> Column:
    """A value in a line, by its kind."""
    figure = show_quantity(value["comparator"], value["number"], value["number_high"], value["unit"])
    return F.when(kind == "quantitative", figure).when(kind == "status", value["state"]).otherwise(value["text"])


def fact_line(kind: Column, entity: Column, attribute: Column, value: Column, label: Column, document: Column) -> Column:
    """entity | attribute | value | period [document]; parts that are missing are left out."""
    parts = F.concat_ws(" | ", entity, attribute, shown_value(kind, value), F.when(F.trim(label) != "", label))
    return F.concat(parts, F.coalesce(F.concat(F.lit(" ["), document, F.lit("]")), F.lit("")))


def display_value(value: Column) -> Column:
    """A figure for a person: signs for comparators, `a–b` for ranges, `~` where none is stated."""
    sign = F.lit("~ ")
    for name, mark in SIGNS.items():
        sign = F.when(value["comparator"] == name, mark).otherwise(sign)
    span = F.concat(plain_number(value["number"]), F.lit("–"), plain_number(value["number_high"]))
    figure = F.when(value["comparator"] == "range", span).otherwise(F.concat(sign, plain_number(value["number"])))
    return F.concat_ws(" ", figure, value["unit"])


def fence(evidence: Column) -> Column:
    """Evidence in which no run of three double quotes can end a quotation; such a run becomes two."""
    return F.regexp_replace(evidence, '"{3,}', '""')


def relative_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes (x0, y0, x1, y1) as shares of a page's width and height."""
    return F.transform(
        boxes, lambda b: F.struct((b["x0"] / width).alias("x0"), (b["y0"] / height).alias("y0"), (b["x1"] / width).alias("x1"), (b["y1"] / height).alias("y1"))
    )
