"""News to topics: tokens, a grid of models, the best one by coherence, articles by topic."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.clustering import LDAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.functions import columns as C
from newspulse.functions import text as X
from newspulse.operators import coherence, tokens, topics
from newspulse.operators.dedup import union_all
from newspulse.session import stage


@dataclass
class TopicTables:
    model: LDAModel
    corpus: topics.Corpus
    scores: DataFrame  # one row per model of the grid
    articles: DataFrame  # articles with topic and representative article
    representatives: DataFrame
    counts: DataFrame  # articles per topic


def prepare(news: DataFrame, stopwords: Iterable[str], dropped: Iterable[str] = (), text_col: str = "title_desc") -> DataFrame:
    """News rows with parsed time, the analysis text and its tokens."""
    return (
        news.withColumn("publishedAtDt", C.iso_timestamp("publishedAt"))
        .withColumn("title_desc", X.concat_strict("title", "description"))
        .transform(tokens.topic_tokens, text_col, stopwords, dropped)
    )


def score_grid(
    models: dict[int, LDAModel], corpus: topics.Corpus, docs: DataFrame, words: int = 20, window: int = 110
) -> DataFrame:
    """(k, score): mean topic coherence per model, one corpus pass for the whole grid."""
    lists = union_all(*[
        topics.topic_words(m, corpus.vocabulary, words).select(F.lit(k).alias("model"), "topic", "term")
        for k, m in models.items()
    ])
    scored = coherence.model_coherence(docs, corpus.key, "tokens", lists, window)
    return scored.withColumnRenamed("model", "k")


def analyse(news: DataFrame, key: str, ks: Iterable[int] = range(15, 26), title: str = "title", **settings) -> TopicTables:
    """Fit the grid on prepared news, keep the most coherent model, label the articles.

    ``settings`` go to the fits (passes, share, seed, priors) and the vocabulary bounds (no_below, no_above,
    prune). ``key`` must be unique and not null.
    """
    bounds = {k: settings.pop(k) for k in ("no_below", "no_above", "prune") if k in settings}
    docs = stage(news.select(key, "tokens"), "tokens")
    corpus = topics.build_corpus(docs, key, **bounds)
    models = topics.train_grid(corpus, ks, **settings)
    scores = stage(score_grid(models, corpus, docs), "coherence")
    best = models[topics.pick_model(scores).first()["k"]]
    names = topics.keywords(topics.topic_words(best, corpus.vocabulary))
    dominant = topics.dominant_topic(topics.document_topics(best, corpus), key, names)
    representatives = topics.representative_documents(dominant, news, key, title)
    articles = topics.topic_articles(news, dominant, representatives, key)
    counts = dominant.groupBy("Topic_Keywords").count().orderBy(F.desc("count"), "Topic_Keywords")
    return TopicTables(best, corpus, scores, articles, representatives, counts)
