"""Exact means: sums stay DECIMAL, so results do not depend on how rows were partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles enter sums as decimals of this type; nothing is rounded to fewer digits afterwards.
EXACT = "decimal(28,15)"


def exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(EXACT)


def ratio(total: Column, n: Column) -> Column:
    """``total / n`` as a double, taken from the exact sum; null when ``n`` is 0."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def mean(column: Column | str) -> Column:
    """Mean of a column of scores as a double, from the exact sum."""
    return ratio(F.sum(exact(column)), F.count(column))
