"""Whole flows from landed rows to published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.catalog.base import (
    ART_SQL, GAZ_SQL, LEX_SQL, ORACLES, articles, documents, gazetteer, lexicon, query, sql_clean_news, sql_clean_tech, sql_entities,
    sql_mean, sql_mean_valence, sql_polarity,
)
from newspulse.catalog.entities import ENTITY_KEY, STRINGS_SQL, entity_polarity_sql
from newspulse.catalog.relational import CLASSES, FAMILIES
from newspulse.catalog.sentiment import COMPOUND_SQL, FIELD_CTES, FIELDS
from newspulse.functions import text as X
from newspulse.plans import articles as A
from newspulse.plans import feed, news

LINK = "'http://news.dk/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || doc_id"


def _daily(spark, sf):
    """Documents as daily files; every fifth one comes again, changed, in a later file."""
    rows = documents(spark, sf).select(
        F.expr(LINK).alias("link"), X.first_line("text").alias("title"), F.col("text").alias("content"), F.col("source").alias("medie"),
        F.concat(F.lit("f"), F.col("doc_id") % 3).alias("Filename"), F.col("doc_id").alias("row_id"))
    again = rows.where("row_id % 5 = 0").withColumns({"Filename": F.lit("g"), "content": F.lit("again"), "title": F.lit("again")})
    return rows.unionByName(again)


DAILY_SQL = f"""art AS (SELECT doc_id, {LINK} AS link, source AS medie, lang, split_part(text, chr(10), 1) AS title, text AS content
    FROM documents WHERE len(text) > 1), {LEX_SQL}, {GAZ_SQL},
    {sql_mean_valence('sc', sql_clean_news('content'))}, {sql_mean_valence('st', 'title')},
    {sql_entities(sql_clean_news('content'))}"""


@query(f"""WITH {DAILY_SQL}, {STRINGS_SQL}
    SELECT link, title, medie, 'f' || doc_id % 3 AS "Filename", {sql_clean_news('content')} AS content_clean,
        sc.score AS sentiment_content, st.score AS sentiment_title, coalesce(enti_str, '') AS enti_str,
        coalesce(lang, 'none') AS category_1, coalesce(medie, 'none') AS category_2
    FROM art JOIN sc USING (doc_id) JOIN st USING (doc_id) LEFT JOIN strs USING (doc_id)""")
def flow_articles(spark, sf):
    """Daily files to the published article table."""
    return A.analyse(_daily(spark, sf), lexicon(spark), gazetteer(spark)).simple.drop("content")


@query(f"""WITH {DAILY_SQL}, once AS (SELECT DISTINCT doc_id, {ENTITY_KEY} AS entity FROM men),
    types AS (SELECT entity, entity_type FROM (SELECT {ENTITY_KEY} AS entity, label AS entity_type,
        row_number() OVER (PARTITION BY {ENTITY_KEY} ORDER BY link DESC, pos DESC) AS r FROM men JOIN art USING (doc_id)) WHERE r = 1)
    SELECT medie, entity, {sql_mean('sc.score')} AS average_sentiment, count(*) AS count, {sql_mean('st.score')} AS average_sentiment_title,
        count(*) AS count_title, any_value(entity_type) AS entity_type
    FROM once JOIN art USING (doc_id) JOIN sc USING (doc_id) JOIN st USING (doc_id) JOIN types USING (entity) GROUP BY medie, entity""")
def flow_articles_entities(spark, sf):
    """Daily files to the published entity table."""
    return A.analyse(_daily(spark, sf), lexicon(spark), gazetteer(spark)).entities


def _news(spark, sf):
    second = F.coalesce(F.get(F.split("content", "\n"), F.lit(1)), F.lit(""))
    rows = articles(spark, sf).select("doc_id", "title", second.alias("description"), "content")
    return news.analyse(rows, lexicon(spark), gazetteer(spark))


TITLES_SQL = f"""{ART_SQL}, {LEX_SQL}, {GAZ_SQL}, {FIELD_CTES}, clean AS (SELECT doc_id, {sql_clean_tech('title')} AS content FROM art),
    {sql_entities(source='clean')}"""


@query(f"""WITH {TITLES_SQL}
    SELECT d.doc_id, {', '.join(f'{f}.pol AS {f}_polarity, {f}.sub AS {f}_subjectivity' for f in FIELDS)},
        array_to_string(list_transform(kept, lambda m: m.t || '/' || m.label), ',') AS entities
    FROM documents d {' '.join(f'JOIN {f} ON {f}.doc_id = d.doc_id' for f in FIELDS)} LEFT JOIN ents ON ents.doc_id = d.doc_id""")
def flow_news(spark, sf):
    """News rows with three scored columns and the entities of their titles."""
    named = F.transform("title_clean_entities", lambda m: F.concat(m["text"], F.lit("/"), m["label"]))
    return _news(spark, sf).select(
        "doc_id", *[f"{f}_{p}" for f in FIELDS for p in ("polarity", "subjectivity")], F.array_join(named, ",").alias("entities"))


@query(entity_polarity_sql('SELECT doc_id, text AS "Entity", label AS "Entity_Type" FROM men', "title"))
def flow_news_entities(spark, sf):
    """Polarity of the entities that news titles name."""
    return news.entity_table(_news(spark, sf), "doc_id")


def _feed_sql(topic: str, classes: str) -> str:
    return f"""SELECT 'u/' || t.doc_id AS url, currency_topic, c.neg, c.neu, c.pos, c.compound, c.sentiment_text
        FROM ({topic}) t JOIN ({classes}) k USING (doc_id) JOIN ({COMPOUND_SQL}) c USING (doc_id)"""


@query(_feed_sql(ORACLES["topic_filter"], ORACLES["currency_class"]))
def flow_feed(spark, sf):
    """Feed items to relevant, classed and scored ones."""
    items = articles(spark, sf).select(
        F.concat(F.lit("u/"), F.col("doc_id")).alias("url"), "title", F.col("content").alias("summary"),
        F.lit("20240102T030405").alias("time_published"))
    done = feed.analyse(items, lexicon(spark), FAMILIES, CLASSES)
    return done.select("url", "currency_topic", "neg", "neu", "pos", "compound", "sentiment_text")
