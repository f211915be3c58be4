"""Cleaned text and tokens of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.catalog.base import (
    CLASS_ROWS, articles, documents, lit, query, sql_clean_news, sql_clean_tech,
    sql_squeeze, sql_topic_words, sql_values, table,
)
from newspulse.functions import text as X
from newspulse.functions.rows import posexploded
from newspulse.operators import tokens as T
from newspulse.resources import words

STOPWORDS = words.stopwords()
STOP_SQL = "(" + ", ".join(lit(w) for w in STOPWORDS) + ")"
TOKENS_SQL = f"list_filter({sql_topic_words('text')}, lambda w: w NOT IN {STOP_SQL})"


@query(f"SELECT doc_id, {sql_clean_news('text')} AS content_clean FROM documents")
def clean_news(spark, sf):
    return documents(spark, sf).select("doc_id", X.clean_news("text").alias("content_clean"))


@query(f"SELECT doc_id, {sql_clean_tech('text')} AS content_clean FROM documents")
def clean_tech(spark, sf):
    return documents(spark, sf).select("doc_id", X.clean_tech("text").alias("content_clean"))


@query(f"SELECT conv_id, turn, {sql_squeeze('text')} AS text FROM conversations")
def squeeze_text(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", X.squeeze("text").alias("text"))


@query("""SELECT doc_id, split_part(text, chr(10), 1) || ' ' || nullif(split_part(text, chr(10), 2), '') AS title_desc
    FROM documents""")
def concat_null(spark, sf):
    lines = F.split("text", "\n")
    description = F.nullif(F.get(lines, F.lit(1)), F.lit(""))
    return articles(spark, sf).select("doc_id", "title", F.col("content").alias("text")).select(
        "doc_id", X.concat_strict("title", description).alias("title_desc")
    )


def topic_token_rows(spark, sf):
    """(doc_id, tokens) of all documents."""
    return T.topic_tokens(documents(spark, sf), "text", STOPWORDS).select("doc_id", "tokens")


@query(f"""SELECT doc_id, array_to_string(t, ' ') AS lemma, len(t) AS n_tokens
    FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)""")
def topic_tokens(spark, sf):
    rows = topic_token_rows(spark, sf)
    return rows.select("doc_id", F.array_join("tokens", " ").alias("lemma"), F.size("tokens").alias("n_tokens"))


@query(f"""
    WITH cls AS (SELECT word, min(pos) AS cls FROM {sql_values(CLASS_ROWS, 'word, pos')} GROUP BY word),
    tok AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS i
        FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)),
    kept AS (SELECT doc_id, word, i FROM tok LEFT JOIN cls USING (word) WHERE coalesce(cls, 'n') IN ('n', 'v'))
    SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS lemma, count(word) AS n_tokens
    FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id""")
def pos_filter(spark, sf):
    kept = T.keep_word_classes(topic_token_rows(spark, sf), "doc_id", words.class_table(spark, CLASS_ROWS))
    return kept.select(
        "doc_id", F.array_join("tokens", " ").alias("lemma"), F.size("tokens").cast("long").alias("n_tokens")
    )


@query(f"""SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token
    FROM (SELECT doc_id, string_split(array_to_string({TOKENS_SQL}, ' '), ' ') AS t FROM documents)""")
def token_split(spark, sf):
    lemma = topic_token_rows(spark, sf).select("doc_id", F.array_join("tokens", " ").alias("lemma"))
    return posexploded(lemma, ["doc_id"], X.split_spaces("lemma"), "token")


DF_SQL = f"""SELECT term, count(*) AS df FROM
    (SELECT doc_id, unnest(list_distinct({TOKENS_SQL})) AS term FROM documents) GROUP BY term"""


@query(DF_SQL)
def doc_frequency(spark, sf):
    return T.document_frequency(topic_token_rows(spark, sf))


@query(f"SELECT term, df FROM ({DF_SQL}) WHERE df >= 10 AND df <= 0.35 * (SELECT count(*) FROM documents)")
def vocab_pruned(spark, sf):
    return T.pruned_vocabulary(topic_token_rows(spark, sf))


@query(f"""SELECT doc_id, term, count(*) AS n FROM
    (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY doc_id, term""")
def bag_of_words(spark, sf):
    return T.bag_of_words(topic_token_rows(spark, sf), "doc_id")
