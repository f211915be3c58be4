"""News table to scored news and entity polarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.functions import text as X
from newspulse.operators import entities as E
from newspulse.operators import sentiment as N
from newspulse.session import numbered_rows

FIELDS = ["title_clean", "content_clean", "description_clean"]


def analyse(news: DataFrame, lexicon: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """News rows with cleaned fields, polarity columns and the title's entities.

    The cleaned rows are staged and read for scores, entities and result; no key has to be unique.
    """
    cleaned = news
    for field in ("title", "description", "content"):
        cleaned = cleaned.withColumn(f"{field}_clean", X.clean_tech(field))
    cleaned = numbered_rows(cleaned)
    scored = N.polarities(cleaned, ["_row"], FIELDS, lexicon)
    lists = E.mention_lists(cleaned, "_row", "title_clean", gazetteer).withColumnRenamed("entities", "title_clean_entities")
    return cleaned.join(scored, "_row", "left").join(lists, "_row", "left").drop("_row")


def entity_table(analysed: DataFrame, key: str, pairing: str = "zip") -> DataFrame:
    columns = ["title_clean_polarity", "description_clean_polarity"]
    with_entities = analysed.select(key, *columns, F.col("title_clean_entities").alias("entities"))
    return E.entity_polarity(with_entities, key, columns, pairing)
