"""Session settings and the two places where a plan meets cluster resources."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on; everything else is left to the deployment.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "newspulse", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the package's settings; ``conf`` wins over the defaults.

    Keyword names use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_dir(spark: SparkSession) -> str:
    """Folder for staged intermediate tables, on storage that the driver and all executors share.

    The session's ``spark.checkpoint.dir``; where that is unset, a folder below the warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the stage folder."""
    return f"{stage_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


_scopes: list[list[str]] = []


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside the block when it ends; write or collect its results before that."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            fs, where = _file_system(spark, path)
            fs.delete(where, True)


def stage(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared stage folder and read it back.

    Used where one expensive table feeds many jobs (a grid of model fits): the lineage is cut, a lost
    executor costs a re-read rather than a recomputation, and the table is computed exactly once. The
    enclosing ``staged_tables`` block deletes it; outside any block it goes when the application ends. With
    ``partition_by``, the last column, a filter on it reads only its own files. ``compression`` is a codec of
    Parquet instead of the session's.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path, compression=compression)
    if _scopes:
        _scopes[-1].append(path)
    else:
        fs, where = _file_system(spark, path)
        fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def numbered_rows(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` staged once, with a column that tells its rows apart whatever their keys are.

    Results computed per row find their way back by it: natural keys may be missing or repeated. The numbers
    are stored with the rows, so every later read sees the same ones.
    """
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "rows")
