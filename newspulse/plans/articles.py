"""Daily articles to scored articles and entity tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.functions import columns as C
from newspulse.functions import text as X
from newspulse.operators import entities as E
from newspulse.operators import sentiment as N
from newspulse.operators.dedup import first_per_key
from newspulse.operators.filters import with_text
from newspulse.session import numbered_rows

SIMPLE_COLUMNS = [
    "link", "title", "content", "medie", "Filename", "content_clean", "sentiment_content", "sentiment_title",
    "enti_str", "category_1", "category_2",
]


@dataclass
class ArticleTables:
    articles: DataFrame  # one row per article, all columns
    simple: DataFrame  # the published column subset
    entities: DataFrame  # one row per (medie, entity)


def prepare(daily: DataFrame) -> DataFrame:
    """One row per link, with text, cleaned content and link categories."""
    return (
        first_per_key(daily, ["link"], ["Filename", "row_id"])
        .drop("row_id")
        .transform(with_text)
        .withColumn("content_clean", X.clean_news("content"))
        .withColumn("category_1", C.link_category("link", 0))
        .withColumn("category_2", C.link_category("link", 1))
    )


def scores(articles: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """(keys, sentiment_content, sentiment_title): content on its cleaned text, the title as it is."""
    fields = {"sentiment_content": "content_clean", "sentiment_title": "title"}
    return N.mean_valences(articles, keys, fields, lexicon).select(*keys, *fields)


def analyse(daily: DataFrame, lexicon: DataFrame, gazetteer: DataFrame, unit: str = "mention") -> ArticleTables:
    """The three published tables. The daily files are read once: the prepared articles are staged.

    Scores and entities come back to their article by a row number, so the one article without a link that is
    kept has its own.
    """
    prepared = numbered_rows(prepare(daily))
    lists = E.mention_lists(prepared, ["_row", "link"], "content_clean", gazetteer)
    articles = (
        prepared.join(scores(prepared, ["_row"], lexicon), "_row", "left")
        .join(lists.drop("link"), "_row", "left")
        .withColumn("enti_str", F.coalesce(E.entity_string("entities"), F.lit("")))
        .drop("_row")
    )
    statistics = E.entity_sentiment(articles, "medie", unit)
    typed = E.attach_types(statistics, E.entity_types(lists, "link"))
    return ArticleTables(articles, articles.select(*SIMPLE_COLUMNS), typed.orderBy(F.asc_nulls_last("average_sentiment"), "entity", "medie"))
