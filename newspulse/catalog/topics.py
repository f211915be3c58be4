"""Coherence of fixed word lists, topic tables counted from these lists, and a real fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.catalog.base import articles, query, sql_values, table
from newspulse.catalog.cleaning import DF_SQL, TOKENS_SQL, topic_token_rows
from newspulse.functions.rows import exploded, small_table
from newspulse.operators import coherence as K
from newspulse.operators import dictionary as D
from newspulse.operators import topics as M
from newspulse.operators import variational as V
from newspulse.session import stage, stage_path

TOPICS, PASSES, SHARE, WINDOW = 5, 2, 0.25, 110
SMOOTH = 0.5

WORD_LISTS = {
    0: "thon ther erin ertion attion anea",
    1: "queque tionment mentre elleau reque onre",
    2: "einheit geheit lichung cheinen erin ther",
}
WORD_ROWS = [(t, w) for t, words in WORD_LISTS.items() for w in words.split()]

COHERENCE_SQL = f"""
    WITH wl AS (SELECT topic, word FROM {sql_values(WORD_ROWS, 'topic, word')}),
    d AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
    total AS (SELECT CAST(sum(greatest(len(t) - {WINDOW} + 1, 1)) AS DOUBLE) AS n FROM d),
    occ AS (SELECT doc_id, last, word, p FROM (SELECT doc_id, greatest(len(t) - {WINDOW}, 0) AS last,
        unnest(t) AS word, unnest(range(len(t))) AS p FROM d) WHERE word IN (SELECT word FROM wl)),
    win AS (SELECT DISTINCT doc_id, word, unnest(range(greatest(p - {WINDOW - 1}, 0), least(p, last) + 1)) AS w FROM occ),
    one AS (SELECT word, count(*) AS c FROM win GROUP BY word),
    two AS (SELECT a.word AS a, b.word AS b, count(*) AS c FROM win a JOIN win b USING (doc_id, w) GROUP BY 1, 2),
    grid AS (SELECT x.topic, x.word AS a, y.word AS b, coalesce(o1.c, 0) / n AS pa, coalesce(o2.c, 0) / n AS pb,
            coalesce(two.c, 0) / n AS pab
        FROM wl x JOIN wl y ON x.topic = y.topic CROSS JOIN total
        LEFT JOIN one o1 ON o1.word = x.word LEFT JOIN one o2 ON o2.word = y.word
        LEFT JOIN two ON two.a = x.word AND two.b = y.word),
    v AS (SELECT topic, a, b, CASE WHEN pa * pb > 0 THEN ln((pab + 1e-12) / (pa * pb)) / -ln(pab + 1e-12) ELSE 0 END AS x FROM grid),
    s AS (SELECT topic, b, sum(x) AS s FROM v GROUP BY topic, b),
    c AS (SELECT v.topic, v.a, sum(x * s) AS dot, sqrt(sum(x * x)) * sqrt(sum(s * s)) AS size
        FROM v JOIN s ON v.topic = s.topic AND v.b = s.b GROUP BY v.topic, v.a)
    SELECT topic, round(avg(CASE WHEN size > 0 THEN dot / size ELSE 0 END), 6) AS coherence FROM c GROUP BY topic"""


@query(COHERENCE_SQL)
def coherence_cv(spark, sf):
    words = small_table(spark, WORD_ROWS, "topic int, term string")
    scored = K.topic_coherence(topic_token_rows(spark, sf), "doc_id", "tokens", words, WINDOW)
    return scored.select("topic", F.round("coherence", 6).alias("coherence"))


N_LISTS = len(WORD_LISTS)

# The tables a model gives, counted instead of fitted: smoothed shares of the word lists in each document, and
# the share of each word in what its list counts.
MODEL_SQL = f"""
    wl AS (SELECT topic, word FROM {sql_values(WORD_ROWS, 'topic, word')}),
    docs AS (SELECT doc_id, source AS medie, split_part(text, chr(10), 1) AS title, {TOKENS_SQL} AS t FROM documents),
    tok AS (SELECT doc_id, unnest(t) AS word FROM docs),
    tc AS (SELECT w.topic, w.word AS term, count(k.word) AS n FROM wl w LEFT JOIN tok k ON k.word = w.word GROUP BY 1, 2),
    tw AS (SELECT topic, term, (n + {SMOOTH}) / (sum(n) OVER (PARTITION BY topic) + {SMOOTH} * count(*) OVER (PARTITION BY topic)) AS weight FROM tc),
    ranked AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) - 1 AS rank, term, weight FROM tw),
    names AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS kw FROM ranked GROUP BY topic),
    dc AS (SELECT doc_id, topic, count(*) AS n FROM tok JOIN wl USING (word) GROUP BY 1, 2),
    hits AS (SELECT doc_id, sum(n) AS total FROM dc GROUP BY 1),
    share AS (SELECT h.doc_id, l.topic, (coalesce(dc.n, 0) + {SMOOTH}) / (h.total + {SMOOTH} * {N_LISTS}) AS p
        FROM hits h CROSS JOIN (SELECT DISTINCT topic FROM wl) l LEFT JOIN dc ON dc.doc_id = h.doc_id AND dc.topic = l.topic),
    best AS (SELECT doc_id, topic, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, topic) AS r FROM share),
    dom AS (SELECT d.doc_id, d.medie, d.title, b.topic AS "Dominant_Topic", round(b.p, 4) AS "Perc_Contribution", kw AS "Topic_Keywords"
        FROM docs d LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (doc_id) LEFT JOIN names ON names.topic = b.topic),
    repr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Dominant_Topic" ORDER BY "Perc_Contribution" DESC, doc_id) AS r
        FROM dom WHERE "Dominant_Topic" IS NOT NULL) WHERE r = 1)"""
REPR_SQL = """"Dominant_Topic" AS "Repr_Dominant_Topic", "Perc_Contribution" AS "Repr_Perc_Contribution",
    "Topic_Keywords" AS "Repr_Topic_Keywords", title AS "Representative_Text\""""


def _weights(spark, sf):
    """(topic, term, weight) of the word lists."""
    lists = small_table(spark, WORD_ROWS, "topic int, term string")
    counts = exploded(topic_token_rows(spark, sf), ["doc_id"], "tokens", "term").join(lists, "term").groupBy("topic", "term").count()
    counted = lists.join(counts, ["topic", "term"], "left").select("topic", "term", F.coalesce("count", F.lit(0)).alias("n"))
    totals = counted.groupBy("topic").agg((F.sum("n") + SMOOTH * F.count("*")).alias("total"))
    return counted.join(totals, "topic").select("topic", "term", ((F.col("n") + SMOOTH) / F.col("total")).alias("weight"))


def _shares(spark, sf):
    """(doc_id, topic_share, n_words): smoothed shares of the lists, null without a listed word.

    Stored: a condition on what is made of them is otherwise pushed below the tokens, which Spark then makes anew
    from the text for every mention of a share.
    """
    def of(words):
        return F.size(F.filter("tokens", lambda w: w.isin(words.split())))

    counts = F.array(*[of(words) for _, words in sorted(WORD_LISTS.items())])
    counted = topic_token_rows(spark, sf).select("doc_id", F.size("tokens").alias("n_words"), counts.alias("c"))
    total = F.aggregate("c", F.lit(0), lambda a, x: a + x)
    share = F.transform("c", lambda n: (n + SMOOTH) / (total + SMOOTH * N_LISTS))
    return stage(counted.select("doc_id", F.when(total > 0, share).alias("topic_share"), "n_words"), "shares")


def _dominant(spark, sf):
    names = M.keywords(M.heaviest_words(_weights(spark, sf)))
    return M.dominant_topic(_shares(spark, sf), "doc_id", names)


def _titles(spark, sf):
    return articles(spark, sf).select("doc_id", "medie", "title")


@query(f"""
    WITH d AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
    df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(t) AS word FROM d) GROUP BY word),
    kept AS (SELECT word FROM df WHERE n >= 10 AND n <= 0.35 * (SELECT count(*) FROM d)),
    has AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(t) AS word FROM d) WHERE word IN (SELECT word FROM kept))
    SELECT d.doc_id, CASE WHEN h.doc_id IS NULL THEN NULL ELSE {TOPICS} END AS n_topics,
        CASE WHEN h.doc_id IS NULL THEN NULL ELSE 1.0::DOUBLE END AS total, h.doc_id IS NOT NULL AS has_term
    FROM d LEFT JOIN has h USING (doc_id)""")
def lda_topics(spark, sf):
    """A fit over the whole corpus: how many topic shares each document has and what they sum to."""
    docs = stage(topic_token_rows(spark, sf), "tokens")
    corpus = M.build_corpus(docs, "doc_id")
    model = M.train(corpus, TOPICS, passes=PASSES, share=SHARE, seed=7)
    shares = M.document_topics(model, corpus)
    total = F.round(F.aggregate("topic_share", F.lit(0.0), lambda a, p: a + p), 6)
    return shares.select(
        "doc_id", F.when(F.col("topic_share").isNotNull(), F.size("topic_share")).alias("n_topics"), total.alias("total"),
        F.col("topic_share").isNotNull().alias("has_term"))


@query(f"WITH {MODEL_SQL} SELECT topic, rank, term, round(weight, 9) AS weight FROM ranked WHERE rank < 5")
def topic_words(spark, sf):
    return M.heaviest_words(_weights(spark, sf), 5).withColumn("weight", F.round("weight", 9))


@query(f'WITH {MODEL_SQL} SELECT doc_id, "Dominant_Topic", "Perc_Contribution", "Topic_Keywords" FROM dom')
def dominant_topic(spark, sf):
    return _dominant(spark, sf)


@query(f"WITH {MODEL_SQL} SELECT {REPR_SQL} FROM repr")
def representative_doc(spark, sf):
    return M.representative_documents(_dominant(spark, sf), _titles(spark, sf), "doc_id")


@query(f"""WITH {MODEL_SQL}, r AS (SELECT {REPR_SQL} FROM repr)
    SELECT dom.*, r.* FROM dom JOIN r ON "Dominant_Topic" = "Repr_Dominant_Topic\"""")
def topic_articles(spark, sf):
    dominant, titles = _dominant(spark, sf), _titles(spark, sf)
    representatives = M.representative_documents(dominant, titles, "doc_id")
    return M.topic_articles(titles, dominant, representatives, "doc_id")


@query(f'WITH {MODEL_SQL} SELECT "Topic_Keywords", count(*) AS count FROM dom WHERE "Topic_Keywords" IS NOT NULL GROUP BY 1')
def topic_counts(spark, sf):
    named = _dominant(spark, sf).dropna(subset=["Topic_Keywords"])
    return named.groupBy("Topic_Keywords").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "Topic_Keywords")


@query(COHERENCE_SQL + " ORDER BY coherence DESC, topic")
def topic_coherence_rank(spark, sf):
    words = M.heaviest_words(_weights(spark, sf), 10).select("topic", "term")
    scored = K.topic_coherence(topic_token_rows(spark, sf), "doc_id", "tokens", words, WINDOW)
    return scored.select("topic", F.round("coherence", 6).alias("coherence")).orderBy(F.desc("coherence"), "topic")


@query(f"""
    WITH {MODEL_SQL},
    nw AS (SELECT doc_id, len(t) AS n FROM docs),
    cover AS (SELECT topic, sum(p * n) / (SELECT sum(n) FROM nw JOIN hits USING (doc_id)) AS share FROM share JOIN nw USING (doc_id) GROUP BY topic),
    overall AS (SELECT term, sum(weight * share) AS p FROM tw JOIN cover USING (topic) GROUP BY term),
    rel AS (SELECT topic, term, share, 0.6 * ln(weight) + 0.4 * ln(weight / p) AS r FROM tw JOIN cover USING (topic) JOIN overall USING (term))
    SELECT topic, term, round(share, 6) AS share, round(r, 6) AS relevance FROM rel""")
def topic_prevalence(spark, sf):
    """Relevance of all listed words, with the share of text that their topic covers."""
    rows = M.relevance(_weights(spark, sf), _shares(spark, sf))
    return rows.select("topic", "term", F.round("share", 6).alias("share"), F.round("relevance", 6).alias("relevance"))


SCORES_SQL = """SELECT k, avg(v) AS score FROM (SELECT event_id % 7 + 2 AS k, floor(value) AS v FROM events) GROUP BY k"""


@query(f"""WITH s AS ({SCORES_SQL})
    SELECT (SELECT k FROM s ORDER BY score DESC, k LIMIT 1) AS k, max(score) AS score, count(*) AS models FROM s""")
def model_pick(spark, sf):
    """The best of a grid of scores; here mean event values stand for mean coherence."""
    scored = table(spark, sf, "events").select((F.col("event_id") % 7 + 2).alias("k"), F.floor("value").alias("v"))
    return M.pick_model(scored.groupBy("k").agg(F.avg("v").alias("score")))


# ---- dictionary without a driver-side vocabulary ------------------------------------------------

IDS_SQL = f"""ids AS (SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df
    FROM ({DF_SQL}) WHERE df >= 3 AND df <= 0.5 * (SELECT count(*) FROM documents))"""


def _dictionary(spark, sf):
    docs = stage(topic_token_rows(spark, sf).select("doc_id", "tokens"), "tokens")
    return docs, D.dictionary(docs, no_below=3, no_above=0.5)


@query(f"WITH {IDS_SQL} SELECT * FROM ids")
def dictionary_ids(spark, sf):
    """Consecutive ids of the terms that the bounds keep."""
    return _dictionary(spark, sf)[1]


@query(f"""WITH {IDS_SQL}, tok AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents)
    SELECT doc_id, term_id, count(*) AS n FROM tok JOIN ids USING (term) GROUP BY doc_id, term_id""")
def dictionary_bow(spark, sf):
    """Bag of words by term id."""
    docs, terms = _dictionary(spark, sf)
    return D.term_counts(docs, "doc_id", terms)


# ---- topics that are known beforehand -----------------------------------------------------------

PLANTED, PLANTED_WORDS, PLANTED_PASSES, GRID = 5, 20, 3, (3, 5, 8)
# Customers are documents and buy the words of one topic, and now and then what customers of all topics buy.
PLANTED_SQL = f"""planted AS (SELECT o_custkey AS doc_id, o_custkey % {PLANTED} AS topic,
        CASE WHEN l_linenumber % 4 = 0 THEN 'all' || l_partkey % 50
            ELSE 't' || o_custkey % {PLANTED} || 'w' || l_partkey % {PLANTED_WORDS} END AS word
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _planted(spark, sf):
    """(training documents, all documents) with their tokens; every fourth customer is held out."""
    sold = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = F.concat(F.lit("t"), F.col("o_custkey") % PLANTED, F.lit("w"), F.col("l_partkey") % PLANTED_WORDS)
    word = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("all"), F.col("l_partkey") % 50)).otherwise(own)
    docs = sold.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list(word).alias("tokens"))
    docs = stage(docs, "planted")
    return docs.where("doc_id % 4 <> 2"), docs


def _planted_batches(spark, sf):
    train, docs = _planted(spark, sf)
    terms = D.dictionary(train, no_below=1, no_above=1.0)
    return V.deal(train, "doc_id", terms, 4), docs, terms


def _planted_fit(spark, sf):
    """(model, its topics with the planted topic that most of their training documents have, documents, terms)"""
    batches, docs, terms = _planted_batches(spark, sf)
    model = V.fit(batches, PLANTED, PLANTED_PASSES)
    fitted = _strongest(model.document_topics(batches.vectors, "doc_id"))
    votes = fitted.groupBy("found", (F.col("doc_id") % PLANTED).alias("topic")).count()
    names = votes.groupBy("found").agg(F.max_by("topic", F.struct("count", "topic")).alias("topic"))
    return model, names, docs, terms


def _strongest(shares):
    best = F.array_position("topic_share", F.array_max("topic_share")) - 1
    return shares.select("doc_id", best.cast("int").alias("found"))


@query(f"""WITH {PLANTED_SQL} SELECT doc_id, any_value(topic) AS topic FROM planted WHERE doc_id % 4 = 2
    GROUP BY doc_id HAVING count(*) >= 10""")
def lda_planted(spark, sf):
    """Held-out documents find the topic they were made of, by a fit that never saw them."""
    model, names, docs, terms = _planted_fit(spark, sf)
    held = docs.where("doc_id % 4 = 2 AND size(tokens) >= 10")
    vectors = D.sparse_vectors(D.term_counts(held, "doc_id", terms), "doc_id")
    return _strongest(model.document_topics(vectors, "doc_id")).join(names, "found").select("doc_id", "topic")


@query(f"WITH {PLANTED_SQL} SELECT DISTINCT topic, word AS term FROM planted WHERE doc_id % 4 <> 2 AND word LIKE 't%'")
def lda_planted_words(spark, sf):
    """The heaviest words of each fitted topic are those it was made of."""
    model, names, _, terms = _planted_fit(spark, sf)
    words = model.topic_words(terms, PLANTED_WORDS).withColumnRenamed("topic", "found")
    return words.join(names, "found").select("topic", "term")


@query(f"""WITH {PLANTED_SQL}, seen AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS words FROM planted WHERE doc_id % 4 <> 2)
    SELECT k, pass, docs, words FROM seen, (VALUES {', '.join(f'({k})' for k in GRID)}) AS t(k), (SELECT unnest(range({PLANTED_PASSES})) AS pass)""")
def lda_grid(spark, sf):
    """Fits of several sizes side by side: the documents and words that each pass has seen, all of them once."""
    batches, _, _ = _planted_batches(spark, sf)
    models = V.fit_grid(batches, GRID, stage_path(spark, "grid"), passes=PLANTED_PASSES)
    rows = [(k, h["pass"], h["docs"], int(h["words"])) for k, m in models.items() for h in m.history]
    return spark.createDataFrame(rows, "k int, pass int, docs long, words long")
