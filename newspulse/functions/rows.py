"""Exploding arrays and building small tables without surprises in the plan."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A column used n times in an expression is otherwise computed up to n times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(df: DataFrame, keep: list[str], array: Column | str, name: str) -> DataFrame:
    """One row per non-null element, next to the ``keep`` columns.

    The outer form of the generator, with the null row filtered afterwards: for the plain form Catalyst
    infers ``size(array) > 0`` below it and evaluates the whole array expression a second time.
    ``keep`` takes column names only: an expression there is evaluated per exploded row and would drag
    its inputs (whole texts) along with every token.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def posexploded(df: DataFrame, keep: list[str], array: Column | str, name: str, pos: str = "pos") -> DataFrame:
    """Like ``exploded`` with the 0-based position; null elements stay, empty arrays drop out."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())


def small_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A driver-side list as a local relation, whose size Catalyst knows exactly.

    A table made from Python rows has no size statistics and would never be chosen for a broadcast
    before both sides of the join are shuffled.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [[] for _ in kind.fields]
    arrow_schema = to_arrow_schema(kind)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), kind)
