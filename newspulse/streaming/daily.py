"""Daily files as a stream: new articles are appended to a stored table without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newspulse import schemas as S
from newspulse.operators.dedup import first_per_key, unseen_keys
from newspulse.session import path_exists
from newspulse.sources.readers import CSV_OPTIONS


def article_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The daily CSV folder as a stream, tagged with the file name; oldest files first."""
    reader = spark.readStream.schema(S.DAILY_ARTICLES).options(**CSV_OPTIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder).select("*", F.col("_metadata.file_name").alias("Filename"))


def append_new(batch: DataFrame, table_path: str, key: str = "link", order: tuple[str, ...] = ("Filename", "row_id")) -> None:
    """Append the batch's first row per key unless the key is already stored.

    Running the same batch again adds nothing, so a replay after a lost driver is harmless.
    """
    spark = batch.sparkSession
    numbered = batch.withColumn("row_id", F.monotonically_increasing_id()) if "row_id" not in batch.columns else batch
    fresh = first_per_key(numbered, [key], list(order)).drop("row_id")
    if path_exists(spark, table_path):  # it does not before the first batch
        fresh = unseen_keys(spark.read.schema(fresh.schema).parquet(table_path), fresh, key)
    fresh.write.mode("append").parquet(table_path)


def run_available(
    stream: DataFrame, table_path: str, checkpoint: str, key: str = "link",
    order: tuple[str, ...] = ("Filename", "row_id"),
) -> StreamingQuery:
    """Process every file that has arrived since the last run, then stop.

    Exact for any delay between repeats: the stored table itself is the memory, no state is kept.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, table_path, key, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_within(stream: DataFrame, delay: str = "7 days", key: str = "link") -> DataFrame:
    """For streams that never end: repeats within ``delay`` are dropped, older keys are forgotten.

    Event time is the day in the file name (``articles_2022-08-01.csv``). State is bounded by the
    delay; a link that returns after it counts as new.
    """
    day = F.to_timestamp(F.regexp_extract("Filename", r"(\d{4}-\d{2}-\d{2})", 1))
    return (
        stream.withColumn("event_time", day)
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark([key])
    )
