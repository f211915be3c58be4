"""Feed items to filtered, classed and scored rows and their time series."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.functions import columns as C
from newspulse.operators import reports, sentiment
from newspulse.operators.filters import topical, two_way_class
from newspulse.resources.patterns import CURRENCIES, EURUSD_NEWS
from newspulse.session import numbered_rows


def analyse(
    items: DataFrame,
    lexicon: DataFrame,
    topics: Mapping[str, Iterable[str]] = EURUSD_NEWS,
    classes: Mapping[str, Iterable[str]] = CURRENCIES,
) -> DataFrame:
    """Relevant items with class, scores, label and parsed time.

    The filter comes first, so only relevant rows are tokenised; they are staged, and every item keeps its own
    scores whether or not its url is missing or repeated.
    """
    kept = numbered_rows(topical(items, topics).withColumn("currency_topic", two_way_class("title", classes)))
    scored = sentiment.compound(kept.select("_row", "summary"), ["_row"], "summary", lexicon)
    return kept.join(scored, "_row", "left").drop("_row").withColumn(
        "time_published_dt", C.compact_timestamp("time_published")
    )


def table_view(analysed: DataFrame, n: int = 20) -> DataFrame:
    columns = ["title", "summary", "currency_topic", "compound", "sentiment_text"]
    return reports.head(analysed, columns, ["url"], n)


def time_series(analysed: DataFrame, classes: tuple[str, ...] = ("USD", "EUR")) -> DataFrame:
    ordered = reports.series(analysed, "currency_topic", list(classes), "time_published_dt", "url")
    return ordered.select("currency_topic", "time_published_dt", F.col("compound"))
