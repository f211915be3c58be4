"""Result tables: group means, counts, rankings, profiles, ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.functions import fixed


def mean_by(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Mean of DECIMAL columns per key; rows with a null key are left out."""
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(*[fixed.mean(c).alias(f"mean_{c}") for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null) for every column, from one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c).alias("non_null")) for c, t in df.dtypes]
    return counts.select(F.inline(F.array(*rows)))


def find_top(entities: DataFrame, min_count: int, n: int) -> DataFrame:
    """The ``n`` most positive entities mentioned in more than ``min_count`` articles."""
    order = [F.desc_nulls_last("average_sentiment"), F.asc("entity"), F.asc("medie")]
    return entities.where(F.col("count") > min_count).orderBy(*order).limit(n)


def find_bottom(entities: DataFrame, min_count: int, n: int) -> DataFrame:
    """The ``n`` most negative entities mentioned in more than ``min_count`` articles."""
    order = [F.asc_nulls_last("average_sentiment"), F.asc("entity"), F.asc("medie")]
    return entities.where(F.col("count") > min_count).orderBy(*order).limit(n)


def series(df: DataFrame, topic: str, keep: list[str], ts: str, tie: str) -> DataFrame:
    """Time-ordered rows of the kept topics, one topic after the other."""
    return df.where(F.col(topic).isin(keep)).orderBy(topic, F.asc_nulls_last(ts), tie)


def head(df: DataFrame, columns: list[str], order: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*order).select(*columns).limit(n)
