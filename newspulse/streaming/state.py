"""Exact removal of repeats in a stream that keeps its own memory: one value per key, in RocksDB, with a time to live."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class FirstOfKey(StatefulProcessor):
    """Passes on the first row of a key by ``order`` in the batch that brings the key, nothing later."""

    def __init__(self, order: tuple[str, ...], ttl_ms: int | None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        yield min(rows, key=lambda r: [(r[c] is None, r[c]) for c in self.order])

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, key: str, order: tuple[str, ...], ttl_ms: int | None = None) -> DataFrame:
    """The stream without rows whose key came before, exact for any delay; null is a key like any other.

    Within a micro-batch the least row by ``order`` is the first (nulls last). A key counts as seen for ``ttl_ms``
    after it was passed on, for ever if that is None. Rows of a key pass one by one, so a hot key needs no memory.
    """
    return stream.groupBy(key).transformWithState(
        statefulProcessor=FirstOfKey(order, ttl_ms), outputStructType=stream.schema, outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime")


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Queries started inside the block keep their state in RocksDB, outside the heap of the executors.

    They run no batches without data: keys past their time to live go with the next data, and a run over what is
    available ends.
    """
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_available(
    stream: DataFrame, table_path: str, checkpoint: str, key: str, order: tuple[str, ...], ttl_ms: int | None = None,
) -> StreamingQuery:
    """Append new first rows to Parquet files for all files that have arrived, then stop.

    State and offsets are in ``checkpoint``, on shared storage; the next run goes on from there, also after a
    lost driver, and the sink commits each micro-batch once. The stored table is never read.
    """
    with state_settings(stream.sparkSession):
        return (
            first_of_key(stream, key, order, ttl_ms).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table_path)
        )
