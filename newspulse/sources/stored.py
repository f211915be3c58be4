"""Stored tables laid out by key, so that an append reads only files that may hold one of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newspulse.operators.dedup import first_per_key
from newspulse.session import path_exists, stage

SLICE = "key_slice"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_slice(key: str, slices: int) -> Column:
    """The folder of a key; null is a key like any other."""
    return F.pmod(F.xxhash64(F.col(_quoted(key))), F.lit(slices)).cast("int")


def create_store(
    spark: SparkSession, name: str, schema: StructType, key: str, path: str, slices: int = 16, buckets: int = 8,
) -> None:
    """Catalog table ``name`` below ``path``: a folder for each slice of the keys, files bucketed and sorted by key.

    Files that are already there, from an earlier session, are part of the table; ``slices`` and ``buckets`` have
    to be those they were written with. An append writes up to ``slices * buckets`` files. Both should grow with
    the table: slices decide how little a small batch reads, buckets how many tasks share a large one.
    """
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    there = path_exists(spark, path)
    spark.sql(f"""CREATE TABLE {name} ({columns}, {SLICE} INT) USING parquet PARTITIONED BY ({SLICE})
        CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) INTO {buckets} BUCKETS LOCATION '{path}'
        TBLPROPERTIES ('key' = '{key}', 'slices' = '{slices}', 'buckets' = '{buckets}')""")
    if there:
        spark.sql(f"MSCK REPAIR TABLE {name}")


def _layout(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def seen_keys(spark: SparkSession, name: str, batch: DataFrame) -> DataFrame:
    """The keys of ``batch`` that are stored, null left out: one column, each key once.

    Only the folders of the batch's slices are read (at most ``slices`` numbers pass through the driver), and of
    them the key column. A batch that Catalyst broadcasts streams past them; a larger one is shuffled to the
    buckets, the stored side stays where it is.
    """
    layout = _layout(spark, name)
    key, slices = layout["key"], int(layout["slices"])
    touched = [r[0] for r in batch.select(key_slice(key, slices)).distinct().collect()]
    keys = batch.select(F.col(_quoted(key))).where(F.col(_quoted(key)).isNotNull()).distinct()
    stored = spark.table(name).where(F.col(SLICE).isin(touched)).select(_quoted(key))
    return stored.join(keys, key, "left_semi").distinct()


def append_unseen(batch: DataFrame, name: str, order: list[str]) -> None:
    """Append the batch's first row per key (by ``order``, which must tell rows of a key apart) unless it is stored.

    The result is that of merging everything and keeping first rows. The same batch again adds nothing. Columns
    of ``order`` need not be stored; null keys are one key.
    """
    spark = batch.sparkSession
    layout = _layout(spark, name)
    key, slices, buckets = layout["key"], int(layout["slices"]), int(layout["buckets"])
    columns = [c for c in spark.table(name).columns if c != SLICE]
    one_each = first_per_key(batch, [key], order).select(*map(_quoted, columns))
    fresh = stage(one_each.withColumn(SLICE, key_slice(key, slices)), "batch")
    of = F.col(_quoted(key))
    named = fresh.where(of.isNotNull()).join(seen_keys(spark, name, fresh), key, "left_anti")
    no_key = fresh.where(of.isNull())
    if not no_key.isEmpty() and spark.table(name).where((F.col(SLICE) == no_key.first()[SLICE]) & of.isNull()).isEmpty():
        named = named.unionByName(no_key)
    # One task a bucket: keys are distinct here, so no bucket is hot. Table and batch are different files.
    (
        named.select(*map(_quoted, columns), SLICE).repartition(buckets, of)
        .write.mode("append").partitionBy(SLICE).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    )
