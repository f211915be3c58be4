"""Sentiment of articles and its group means."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.catalog.base import (
    ART_SQL, LEX_SQL, SQL_CHUNK, articles, lexicon, lit, pages, polarity_label_sql, query, sql_clean_news,
    sql_clean_tech, sql_mean, sql_mean_valence, sql_polarity,
)
from newspulse.catalog.html import ARTICLE_SQL
from newspulse.functions import columns as C
from newspulse.functions import text as X
from newspulse.operators import html as O
from newspulse.operators import reports
from newspulse.operators import sentiment as N
from newspulse.plans import articles as A


def scored_articles(spark, sf):
    """(doc_id, medie, sentiment_content, sentiment_title): content cleaned, title as it is."""
    cleaned = articles(spark, sf).withColumn("content_clean", X.clean_news("content"))
    return A.scores(cleaned, ["doc_id", "medie"], lexicon(spark))


SCORES_SQL = f"""{ART_SQL}, {LEX_SQL},
    {sql_mean_valence('sc', sql_clean_news('content'))},
    {sql_mean_valence('st', 'title')},
    scored AS (SELECT doc_id, medie, sc.score AS c, st.score AS t
        FROM art JOIN sc USING (doc_id) JOIN st USING (doc_id))"""


@query(f"WITH {SCORES_SQL} SELECT doc_id, medie, c AS sentiment_content, t AS sentiment_title FROM scored")
def sentiment_mean(spark, sf):
    return scored_articles(spark, sf).select(
        "doc_id", "medie", F.col("sentiment_content").cast("double"), F.col("sentiment_title").cast("double")
    )


@query(f"""WITH {SCORES_SQL} SELECT medie, {sql_mean('c')} AS mean_sentiment_content,
    {sql_mean('t')} AS mean_sentiment_title FROM scored GROUP BY medie""")
def sentiment_by_media(spark, sf):
    return reports.mean_by(scored_articles(spark, sf), ["medie"], "sentiment_content", "sentiment_title")


@query(f"""WITH art AS ({ARTICLE_SQL}), {LEX_SQL},
    {sql_mean_valence('sc', sql_clean_news('content'), key='page_id')},
    cat AS (SELECT page_id, list_filter(string_split(link, '/')[4:-2], lambda s: s <> '')[1] AS category_1 FROM art)
    SELECT category_1, {sql_mean('score')} AS mean_sentiment_content
    FROM cat JOIN sc USING (page_id) WHERE category_1 IS NOT NULL GROUP BY category_1""")
def sentiment_by_category(spark, sf):
    rows = (
        O.page_articles(pages(spark, sf))
        .withColumn("content_clean", X.clean_news("content"))
        .withColumn("category_1", C.link_category("link", 0))
    )
    scores = N.mean_valence(rows, ["page_id", "category_1"], "content_clean", lexicon(spark), "sentiment_content")
    return reports.mean_by(scores, ["category_1"], "sentiment_content")


@query(f"""WITH {ART_SQL}, {LEX_SQL}, {sql_polarity('p', sql_clean_tech('content'))}
    SELECT doc_id, pol AS polarity, sub AS subjectivity, {polarity_label_sql('pol')} AS polarity_label
    FROM p""")
def sentiment_polarity(spark, sf):
    rows = articles(spark, sf).withColumn("content_clean", X.clean_tech("content"))
    scored = N.polarity(rows, ["doc_id"], "content_clean", lexicon(spark))
    return scored.withColumn("polarity", F.col("polarity").cast("double")).withColumn(
        "subjectivity", F.col("subjectivity").cast("double")
    )


FIELDS = {
    "title_clean": "title",
    "content_clean": "content",
    "description_clean": "split_part(content, chr(10), 2)",
}


def cleaned_fields(spark, sf):
    """(doc_id, medie, title_clean, content_clean, description_clean); the second line is the description."""
    second = F.coalesce(F.get(F.split("content", "\n"), F.lit(1)), F.lit(""))
    return articles(spark, sf).select(
        "doc_id", "medie", X.clean_tech("title").alias("title_clean"),
        X.clean_tech("content").alias("content_clean"), X.clean_tech(second).alias("description_clean"),
    )


FIELD_CTES = ", ".join(sql_polarity(f, sql_clean_tech(e)) for f, e in FIELDS.items())


@query(f"""WITH {ART_SQL}, {LEX_SQL}, {FIELD_CTES}
    SELECT doc_id, {', '.join(f'''{f}.pol AS {f}_polarity, {f}.sub AS {f}_subjectivity,
        {polarity_label_sql(f + '.pol')} AS {f}_polarity_label''' for f in FIELDS)}
    FROM title_clean JOIN content_clean USING (doc_id) JOIN description_clean USING (doc_id)""")
def multi_column_sentiment(spark, sf):
    scored = N.polarities(cleaned_fields(spark, sf), ["doc_id"], list(FIELDS), lexicon(spark))
    return scored.select("doc_id", *[
        F.col(f"{f}_{p}").cast(t).alias(f"{f}_{p}")
        for f in FIELDS for p, t in [("polarity", "double"), ("subjectivity", "double"), ("polarity_label", "string")]
    ])


def _sgn(c):
    return f"CASE WHEN {c} < 0 THEN -1 ELSE 1 END"


def _neg(c):
    return f"CASE WHEN {c} = 'negation' THEN CAST(-0.74 AS DECIMAL(3,2)) ELSE CAST(1.00 AS DECIMAL(3,2)) END"


COMPOUND_SQL = f"""
    WITH {LEX_SQL},
    base AS (SELECT doc_id, text, regexp_extract_all(text, {lit(SQL_CHUNK)}) AS raw,
        regexp_extract_all(lower(text), {lit(SQL_CHUNK)}) AS low FROM documents),
    tok AS (SELECT doc_id, unnest(raw) AS r, unnest(low) AS w, unnest(range(1, len(low) + 1)) AS i FROM base),
    caps AS (SELECT *, (r = upper(r) AND r <> lower(r)) AS up,
            lag(w, 1) OVER d AS p1, lag(w, 2) OVER d AS p2, lag(w, 3) OVER d AS p3
        FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    per AS (SELECT doc_id, count(*) AS words, bool_or(up) AND bool_or(NOT up) AS mixed,
        coalesce(min(i) FILTER (WHERE w = 'but'), 0) AS but FROM caps GROUP BY doc_id),
    hit AS (SELECT c.*, mixed, but, CAST(h.v / 1000.0 AS DECIMAL(9,3)) AS v,
            k1.kind AS k1, k2.kind AS k2, k3.kind AS k3,
            CAST(CASE WHEN k1.kind = 'booster' THEN k1.v ELSE 0 END / 1000.0 AS DECIMAL(6,3)) AS b1,
            CAST(CASE WHEN k2.kind = 'booster' THEN k2.v ELSE 0 END / 1000.0 AS DECIMAL(6,3)) AS b2,
            CAST(CASE WHEN k3.kind = 'booster' THEN k3.v ELSE 0 END / 1000.0 AS DECIMAL(6,3)) AS b3
        FROM caps c JOIN per USING (doc_id) JOIN lex h ON c.w = h.word AND h.kind = 'valence'
        LEFT JOIN lex k1 ON c.p1 = k1.word AND k1.kind <> 'valence'
        LEFT JOIN lex k2 ON c.p2 = k2.word AND k2.kind <> 'valence'
        LEFT JOIN lex k3 ON c.p3 = k3.word AND k3.kind <> 'valence'),
    s0 AS (SELECT *, CAST(v + CASE WHEN up AND mixed THEN 0.733 * {_sgn('v')} ELSE 0 END AS DECIMAL(9,3)) AS x0 FROM hit),
    s1 AS (SELECT *, CAST(CAST(x0 + {_sgn('x0')} * b1 AS DECIMAL(12,3)) * {_neg('k1')} AS DECIMAL(15,5)) AS x1 FROM s0),
    s2 AS (SELECT *, CAST(CAST(x1 + {_sgn('x1')} * b2 * CAST(0.95 AS DECIMAL(3,2)) AS DECIMAL(16,5)) * {_neg('k2')} AS DECIMAL(20,7)) AS x2 FROM s1),
    s3 AS (SELECT *, CAST(CAST(x2 + {_sgn('x2')} * b3 * CAST(0.90 AS DECIMAL(3,2)) AS DECIMAL(20,7)) * {_neg('k3')} AS DECIMAL(24,9)) AS x3 FROM s2),
    s AS (SELECT doc_id, CAST(x3 * CASE WHEN but > 0 AND i < but THEN CAST(0.5 AS DECIMAL(2,1))
        WHEN but > 0 AND i > but THEN CAST(1.5 AS DECIMAL(2,1)) ELSE CAST(1.0 AS DECIMAL(2,1)) END AS DECIMAL(26,10)) AS x FROM s3),
    g AS (SELECT doc_id, sum(x) AS total, sum(x + 1) FILTER (WHERE x > 0) AS up,
        sum(1 - x) FILTER (WHERE x < 0) AS down, count(*) FILTER (WHERE x <> 0) AS hits FROM s GROUP BY doc_id),
    f AS (SELECT b.doc_id, CAST(coalesce(total, 0) AS DOUBLE) AS total, CAST(coalesce(up, 0) AS DOUBLE) AS up,
            CAST(coalesce(down, 0) AS DOUBLE) AS down, CAST(len(low) - coalesce(hits, 0) AS DOUBLE) AS neutral,
            CAST(least(bang, 4) * 0.292 + CASE WHEN ask > 3 THEN 0.96 WHEN ask > 1 THEN ask * 0.18 ELSE 0 END AS DOUBLE) AS loud
        FROM (SELECT *, len(text) - len(replace(text, '!', '')) AS bang, len(text) - len(replace(text, '?', '')) AS ask FROM base) b
        LEFT JOIN g USING (doc_id)),
    e AS (SELECT doc_id, total + sign(total) * loud AS x, up + CASE WHEN up > down THEN loud ELSE 0 END AS u,
        down + CASE WHEN down > up THEN loud ELSE 0 END AS d, neutral FROM f),
    z AS (SELECT *, u + d + neutral AS n FROM e),
    r AS (SELECT doc_id, coalesce(round(d / nullif(n, 0), 3), 0) AS neg, coalesce(round(neutral / nullif(n, 0), 3), 0) AS neu,
        coalesce(round(u / nullif(n, 0), 3), 0) AS pos, round(x / sqrt(x * x + 15), 4) AS compound FROM z)
    SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_text
    FROM r"""


@query(COMPOUND_SQL)
def sentiment_compound(spark, sf):
    rows = articles(spark, sf).select("doc_id", "content")
    return N.compound(rows, ["doc_id"], "content", lexicon(spark))
