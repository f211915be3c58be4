"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# White space between words, everywhere in this subpackage: space and the controls from tab to return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SLICE = 128  # texts whose results are held as Python objects at a time
BATCH_ROWS = 512  # rows of an Arrow batch between the JVM and Python


def small_batches() -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows: whole texts are large, and a batch is held
    several times outside the heap of an executor."""
    conf, name = SparkSession.active().conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)


def text_udf(make: Callable[[], Callable[[str | None], tuple]], schema: T.StructType) -> Callable[[Column], Column]:
    """A struct of values for each text, from an Arrow batch function.

    ``make`` runs once per task and returns the function for one text (None for null), whose tuple has
    the fields of ``schema``. Only the text column travels to Python; all others stay with their row.
    """
    fields = to_arrow_schema(schema)
    small_batches()

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            for at in range(0, max(len(batch), 1), SLICE):
                columns = list(zip(*[one(t.as_py()) for t in batch.slice(at, SLICE)])) or [[] for _ in fields]
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, fields)]
                yield pa.StructArray.from_arrays(arrays, fields=list(fields))

    return run


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ref(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
