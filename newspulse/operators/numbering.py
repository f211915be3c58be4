"""Consecutive numbers over whole tables, and what they allow: ids of terms, tables lined up by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newspulse.session import stage


def consecutive(df: DataFrame, order: list[Column], name: str = "row_number", start: int = 0) -> DataFrame:
    """``df`` with the numbers ``start``, ``start`` + 1, ... in the order of ``order``, stored.

    Rows are sorted in ranges, and a range begins with the sum of the counts of those before it: the window runs
    over one row per range, never over the table. Rows alike in all of ``order`` are told apart by a stored
    number, so very many of them still make several ranges.
    """
    tied = stage(df.withColumn("_tie", F.monotonically_increasing_id()), "rows")
    by = [*order, F.col("_tie").asc()]
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    bases = bases.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start - F.col("_first")).alias("_base"))
    return placed.join(bases, "_range").withColumn(name, F.col("_at") + F.col("_base")).drop("_at", "_range", "_base")


def positional_join(
    left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], how: str = "inner", position: str = "position",
) -> DataFrame:
    """Two tables side by side: the n-th row of one with the n-th of the other, each in its own order.

    ``how`` is ``inner`` (up to the end of the shorter one) or ``outer`` (the shorter one is filled up with
    nulls). Positions count from 0. Column names of the two must differ.
    """
    if how not in ("inner", "outer"):
        raise ValueError(f"how must be 'inner' or 'outer', not {how!r}")
    a, b = consecutive(left, left_order, position), consecutive(right, right_order, position)
    return a.join(b, position, "inner" if how == "inner" else "full").select(position, *left.columns, *right.columns)
