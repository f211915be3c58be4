"""Duplicates, first and best rows per key, unions, append without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newspulse.operators.filters import drop_placeholder


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``; null keys count as one key.

    An aggregate, not a window: every task keeps one row per key before the shuffle, so a key (or the
    null key) that holds a large share of the table never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None, salts: int = 64
) -> DataFrame:
    """The ``n`` best rows of every group, exactly. ``order`` should end in a unique column.

    Each group is cut to its best rows in ``salts`` slices first, so no task sorts a whole hot group and at
    most ``salts * n`` rows of a group meet in the end.
    """
    name = rank or "_rank"
    slices = Window.partitionBy(*keys, "_slice").orderBy(*order)
    df = (
        df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        .withColumn("_rank_in_slice", F.row_number().over(slices))
        .where(F.col("_rank_in_slice") <= n)
        .drop("_slice", "_rank_in_slice")
    )
    whole = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_distinct(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing plus new rows, each distinct row once, withdrawn articles removed (the full result)."""
    return drop_placeholder(union_all(existing, new)).distinct()


def unseen_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The rows an append has to add so that the table equals ``merge_distinct``.

    For an existing table that is already distinct and clean. Appending these avoids rewriting it. Only stored
    rows with the hash of a new row are compared: while the batch is small, its hashes are broadcast and the
    stored side is scanned but not shuffled.
    """
    fresh = drop_placeholder(new.select(*existing.columns))
    hashes = fresh.select(F.xxhash64(*fresh.columns).alias("_hash")).distinct()
    alike = existing.withColumn("_hash", F.xxhash64(*existing.columns)).join(hashes, "_hash", "left_semi").drop("_hash")
    return fresh.subtract(alike)


def unseen_keys(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of a small batch whose key is not stored yet; null is a key like any other.

    The stored table is only scanned for its key column and streams past the batch's keys: when the
    batch is small enough for Catalyst to broadcast, the stored side is never shuffled.
    """
    keys = batch.select(F.col(key).alias("_k")).distinct()
    stored = existing.select(F.col(key).alias("_stored"))
    seen = stored.join(keys, F.col("_stored").eqNullSafe(F.col("_k")), "left_semi").distinct()
    return batch.join(seen, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")
