"""Sinks: snapshots by day, tables that are replaced while being read, model folders."""

from __future__ import annotations

from datetime import date

from pyspark.ml.clustering import DistributedLDAModel, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(
    df: DataFrame, path: str, run_date: date | None = None, enabled: bool = True, fmt: str = "parquet"
) -> bool:
    """Write the table as the snapshot of one day; a rerun of the day replaces only that day.

    Returns whether anything was written. Readers prune by ``run_date``.
    """
    if not enabled:
        return False
    day = F.lit(run_date) if run_date else F.current_date()
    (
        df.withColumn("run_date", day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("run_date")
        .format(fmt)
        .save(path)
    )
    return True


def csv_export(df: DataFrame, path: str) -> None:
    """CSV with a header, text quoted so that newlines and quotes survive a re-read."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def replace_table(df: DataFrame, name: str) -> None:
    """Replace a catalog table by rows that may have been read from it.

    The new rows are written to a staging table first and take the old table's name by renaming:
    nothing is copied twice, and the old rows exist until the new ones are complete.
    """
    spark = df.sparkSession
    staging, old = f"{name}__staging", f"{name}__old"
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    df.write.saveAsTable(staging)
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def replace_jdbc_table(df: DataFrame, name: str, jdbc: dict[str, str]) -> None:
    """The same over JDBC: land the rows in a staging table, then copy them over the target.

    The second step reads the staging table, not the target, so replacing a table by a query on itself
    is safe. ``truncate`` keeps the target's definition and grants.
    """
    staging = f"{name}__staging"
    df.write.format("jdbc").options(**{**jdbc, "dbtable": staging}).mode("overwrite").save()
    landed = df.sparkSession.read.format("jdbc").options(**{**jdbc, "dbtable": staging}).load()
    landed.write.format("jdbc").options(**{**jdbc, "dbtable": name, "truncate": "true"}).mode("overwrite").save()


def save_model(
    path: str, run_id: str, model: LDAModel, counter: CountVectorizerModel, enabled: bool = True, **tables: DataFrame
) -> str | None:
    """Model, vocabulary and the tables that belong to one run, under ``run_id=...``."""
    if not enabled:
        return None
    folder = f"{path.rstrip('/')}/run_id={run_id}"
    model.write().overwrite().save(f"{folder}/lda_model")
    counter.write().overwrite().save(f"{folder}/vocabulary")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def load_model(spark: SparkSession, folder: str) -> tuple[LDAModel, CountVectorizerModel]:
    """A saved run's model and vocabulary; ``spark`` only makes sure a session exists."""
    kind = spark.read.text(f"{folder}/lda_model/metadata").first()[0]
    loader = DistributedLDAModel if "DistributedLDAModel" in kind else LocalLDAModel
    return loader.load(f"{folder}/lda_model"), CountVectorizerModel.load(f"{folder}/vocabulary")
