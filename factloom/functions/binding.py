"""Binding a value inside an expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it; keeps large expressions small."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)
