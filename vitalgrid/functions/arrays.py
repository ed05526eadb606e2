"""Small helpers on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def median(a: Column) -> Column:
    """Of an array in ascending order."""
    n = F.size(a)
    return (F.element_at(a, ((n + 1) / 2).cast("int")) + F.element_at(a, ((n + 2) / 2).cast("int"))) / 2.0
