"""Sources, each with its declared schema."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse import schemas as S
from newspulse.functions.encoding import decoded, encoding_of, lenient
from newspulse.operators.dedup import top_per_group
from newspulse.operators.filters import in_window
from newspulse.sources import variants

# A file whose header has other names or another order than the schema is an error, never read by position.
CSV_OPTIONS = {"header": True, "enforceSchema": False, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One CSV file or folder with a header; quoted text may contain newlines."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def daily_articles(spark: SparkSession, folder: str) -> DataFrame:
    """All daily CSV files of a folder, tagged with their file name and a row number within the file.

    Multi-line files are read whole, one file per task, so the low bits of the generated id follow the
    order of the rows. The number only has to order rows of the same file.
    """
    return csv_table(spark, folder, S.DAILY_ARTICLES).select(
        "*", F.col("_metadata.file_name").alias("Filename"), F.monotonically_increasing_id().alias("row_id")
    )


def _flat(prefix: str, struct: T.StructType) -> list[Column]:
    """Leaf columns of a nested record, ``source.id`` becoming ``source_id``."""
    out = []
    for field in struct.fields:
        if isinstance(field.dataType, T.StructType):
            out += [
                F.col(f"{prefix}.{field.name}.{leaf.name}").alias(f"{field.name}_{leaf.name}")
                for leaf in field.dataType.fields
            ]
        else:
            out.append(F.col(f"{prefix}.{field.name}"))
    return out


def unnest(envelopes: DataFrame, list_column: str) -> DataFrame:
    """One row per record of an envelope's list, nested fields flattened."""
    record = envelopes.schema[list_column].dataType.elementType
    return envelopes.select(F.explode(list_column).alias("_r")).select(*_flat("_r", record))


def json_articles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """News documents; ``multi_line=False`` for files with one document per line, which can be split."""
    envelopes = spark.read.schema(S.NEWS_ENVELOPE).option("multiLine", multi_line).json(path)
    return unnest(envelopes, "articles")


def json_sources(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Source documents; ``multi_line=False`` for files with one document per line, which can be split."""
    envelopes = spark.read.schema(S.SOURCES_ENVELOPE).option("multiLine", multi_line).json(path)
    return unnest(envelopes, "sources")


def json_feed(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items, status): the feed's rows, and per document whether it is JSON and its list was there.

    Items have the declared columns and ``rest``, the whole item as VARIANT, with every key it came with. A
    document that is no JSON or lacks the list gives no rows instead of an error; ``status`` says so.
    """
    documents = variants.json_documents(spark, path, multi_line)
    status = variants.status(documents, "feed", "Information", "Note").withColumnRenamed("has_list", "has_feed")
    return variants.items(documents, "feed", S.FEED_ITEM).drop("file_name", "pos"), status


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed HTML files as (url, encoding, html); the file path stands for the address.

    Files are read as bytes and decoded by their byte-order mark or the encoding they declare.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("url"), "content")
    return decoded_pages(files)


def decoded_pages(pages: DataFrame, content: str = "content") -> DataFrame:
    """``encoding`` and ``html`` in place of a page's bytes; see ``functions.encoding`` for the rules."""
    with lenient(pages.sparkSession):
        named = pages.withColumn("encoding", encoding_of(F.col(content)))
        return named.withColumn("html", decoded(F.col(content), F.col("encoding"))).drop(content)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each text file as one row (file_name, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
    )


def sql_table(spark: SparkSession, name: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A whole table of the catalog, or over JDBC.

    ``jdbc`` takes the Spark JDBC options. ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` split the read; without them one task reads everything.
    """
    if jdbc is None:
        return spark.table(name)
    return spark.read.format("jdbc").options(**{**jdbc, "dbtable": name}).load()


def choose_sources(
    sources: DataFrame, language: str | None = "en", country: str | None = "us", category: str | None = "technology"
) -> DataFrame:
    """Source table narrowed by language, country and category (``None`` accepts all), its id as ``source_id``."""
    wanted = {"language": language, "country": country, "category": category}
    for column, value in wanted.items():
        if value is not None:
            sources = sources.where(F.col(column) == value)
    return sources.withColumnRenamed("id", "source_id")


def landed_articles(
    articles: DataFrame,
    sources: DataFrame,
    first_day: date | Column,
    last_day: date | Column,
    pages: int = 5,
    page_size: int = 20,
    ts: str = "published",
    source: str = "source_id",
    popularity: str = "popularity",
    tie: str = "url",
) -> DataFrame:
    """The first pages of each chosen source within a range of days, most popular first.

    ``sources`` is the source table, already narrowed by language, country or category. Adds ``page``.
    """
    chosen = in_window(articles, ts, first_day, last_day).join(sources.select(source), source, "left_semi")
    order = [F.desc_nulls_last(popularity), F.asc(tie)]
    ranked = top_per_group(chosen, [source], order, pages * page_size, rank="_rank")
    return ranked.withColumn("page", F.floor((F.col("_rank") - 1) / page_size) + 1).drop("_rank")


def latest_days(today: Column | None = None, back_from: int = 5, back_to: int = 1) -> tuple[Column, Column]:
    """The default pull: from five days ago to yesterday."""
    now = today if today is not None else F.current_date()
    return F.date_sub(now, back_from), F.date_sub(now, back_to)


def latest_feed(
    items: DataFrame, ts: str, tie: str, today: date | datetime | None = None, limit: int = 1000
) -> DataFrame:
    """Items since 1 January of the previous year, newest first, at most ``limit``."""
    now = F.lit(today) if today else F.current_date()
    since = F.make_timestamp(F.year(now) - 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return items.where(F.col(ts) >= since).orderBy(F.desc(ts), F.asc(tie)).limit(limit)
