"""Rectangles to polygon vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rectangle_vertices(df: DataFrame, width: str = "W", depth: str = "D") -> DataFrame:
    """Four rows per rectangle with X, Y and Order 1..4, round from the origin, in one pass."""
    w, d, zero = F.col(width).cast("double"), F.col(depth).cast("double"), F.lit(0.0)
    corners = [(zero, zero), (zero, d), (w, d), (w, zero)]
    vertices = F.array(*[
        F.struct(x.alias("X"), y.alias("Y"), F.lit(i).alias("Order")) for i, (x, y) in enumerate(corners, 1)
    ])
    return df.select("*", F.inline(vertices))
