"""JSON documents of unknown shape: every key survives, whatever the declared schema says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file_name, raw, doc): each document as text and as VARIANT; ``doc`` is null where it is no valid JSON.

    ``multi_line=False`` is for files with one document per line, which can be split; blank lines are no
    documents.
    """
    rows = spark.read.text(path, wholetext=multi_line).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    return parsed(rows.where(F.trim("raw") != ""))


def parsed(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``doc``, the VARIANT of a text column; null where that is no valid JSON."""
    return rows.withColumn("doc", F.try_parse_json(raw))


def bad_documents(documents: DataFrame) -> DataFrame:
    """(file_name, raw) of the documents that are no valid JSON."""
    return documents.where(F.col("doc").isNull()).select("file_name", "raw")


def child(key: str) -> str:
    """Path step to a key with any signs in it."""
    return '["' + key.replace('"', '\\"') + '"]'


def items(documents: DataFrame, list_key: str, fields: T.StructType, rest: str = "rest") -> DataFrame:
    """One row per entry of the documents' list: the declared fields, and ``rest``, the whole entry as VARIANT.

    A declared field that is missing or has another type is null; what the entry says about it is still in
    ``rest``. Documents without the list, or with something else in its place, give no rows. All other columns
    of ``documents`` but ``raw`` and ``doc`` ride along.
    """
    keep = [c for c in documents.columns if c not in ("raw", "doc")]
    listed = documents.withColumn("_list", F.try_variant_get("doc", "$" + child(list_key), "array<variant>"))
    rows = listed.select(*keep, F.posexplode("_list").alias("pos", rest))
    declared = [F.try_variant_get(rest, "$" + child(f.name), f.dataType.simpleString()).alias(f.name) for f in fields]
    return rows.select(*keep, "pos", *declared, rest)


def status(documents: DataFrame, list_key: str, *messages: str) -> DataFrame:
    """(file_name, valid, has_list, message): per document whether it is JSON, whether its list is there, and the
    first of the ``messages`` keys that it has instead."""
    said = [F.try_variant_get("doc", "$" + child(m), "string") for m in messages]
    return documents.select(
        "file_name", F.col("doc").isNotNull().alias("valid"),
        F.try_variant_get("doc", "$" + child(list_key), "array<variant>").isNotNull().alias("has_list"),
        F.coalesce(*said, F.lit(None).cast("string")).alias("message"))


def nesting(document: Column) -> Column:
    """How deep objects and arrays are nested in a VARIANT; 0 for a plain value."""
    marks = F.regexp_replace(F.to_json(document), r'"(?:[^"\\]|\\.)*+"|[^\[\]{}]', "")
    steps = F.transform(F.split(marks, ""), lambda m: F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        now = a["now"] + x
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.coalesce(F.aggregate(steps, start, step, lambda a: a["most"]), F.lit(0))


def leaves(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Every plain value at any depth: (keys, path, kind, value).

    ``path`` is written ``$["key"][0]``, ``kind`` is the type, ``value`` the text of the value (null for a JSON
    null). Empty objects and arrays are leaves of their own, so no key is lost. How deep to go is read from the
    documents. Null documents give no rows.
    """
    depth = df.agg(F.max(nesting(F.col(document)))).first()[0] or 0
    rows = df.where(F.col(document).isNotNull()).select(*keys, F.lit("$").alias("path"), F.col(document).alias("v"))
    found = []
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        nested = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (F.to_json("v") != "[]"))
        found.append(rows.where(~nested))
        rows = _entries(rows.where(nested), keys)
    out = rows
    for f in found:
        out = out.unionByName(f)
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    text = F.when(kind.isin("OBJECT", "ARRAY"), F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
    return out.select(*keys, "path", kind.alias("kind"), text.alias("value"))


def _entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of objects and arrays, one level down."""
    spark = rows.sparkSession
    exploded = spark.sql(
        "SELECT r.*, e.pos AS _pos, e.key AS _key, e.value AS _value FROM {rows} r, LATERAL variant_explode(r.v) e", rows=rows)
    step = F.when(F.col("_key").isNotNull(), F.concat(F.lit('["'), F.replace(F.col("_key"), F.lit('"'), F.lit('\\"')), F.lit('"]')))
    step = F.coalesce(step, F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
    return exploded.select(*keys, F.concat("path", step).alias("path"), F.col("_value").alias("v"))
