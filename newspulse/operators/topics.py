"""Topic models on the corpus: vocabulary, fits, topic tables, articles per topic.

Fits use ``pyspark.ml``. Everything that is as small as the model (topics x words) stays a small table;
everything per article stays on the article's row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newspulse.operators.dedup import top_per_group
from newspulse.operators.tokens import document_frequency, pruned_vocabulary
from newspulse.session import stage, stage_path

@dataclass
class Corpus:
    """Count vectors by document key, staged once because every fit and transform reads them."""

    vectors: DataFrame  # key, features, n_words
    vocabulary: DataFrame  # term_id, term
    counter: CountVectorizerModel
    key: str
    size: int


def build_corpus(
    df: DataFrame,
    key: str,
    tokens: str = "tokens",
    no_below: int = 10,
    no_above: float = 0.35,
    prune: bool = True,
) -> Corpus:
    """Count vectors over the vocabulary. ``prune=False`` keeps every term whatever its frequency.

    The pruning bounds alone decide what is kept; the driver and the model hold all kept terms, so a large
    corpus wants bounds. The vectoriser is fitted on the list of terms, not on the texts. ``df`` is read
    twice: stage it first when its tokens are expensive.
    """
    words = df.select(key, F.array_remove(tokens, "").alias("_words"))
    kept = pruned_vocabulary(words, "_words", no_below, no_above) if prune else document_frequency(words, "_words")
    terms = stage(kept.select("term"), "terms")
    n_terms = terms.count()
    if not n_terms:
        raise ValueError("no term is within the bounds")
    listed = terms.select(F.array("term").alias("_words"))
    counter = CountVectorizer(inputCol="_words", outputCol="features", vocabSize=n_terms).fit(listed)
    vectors = counter.transform(words).select(key, "features", F.size("_words").alias("n_words"))
    staged = stage(vectors, "corpus")
    return Corpus(staged, vocabulary_table(counter), counter, key, staged.count())


def vocabulary_table(counter: CountVectorizerModel) -> DataFrame:
    """(term_id, term), read back from the saved model: the words never pass through Python one by one."""
    spark = SparkSession.active()
    path = stage_path(spark, "vocabulary")
    counter.save(path)
    return spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("term_id", "term"))


def train(
    corpus: Corpus, k: int, passes: float = 250, share: float = 0.05, seed: int = 0,
    document_prior: float = 0.5, word_prior: float = 0.01,
) -> LDAModel:
    """Online LDA with fixed priors: ``passes`` sweeps over the corpus, a ``share`` of it in each iteration.

    The number of iterations, ``passes / share``, does not depend on the size of the corpus, and what is read
    in all is ``passes`` times the corpus at any size. A smaller share updates the topics more often.
    """
    lda = LDA(
        k=k, optimizer="online", docConcentration=[document_prior], topicConcentration=word_prior,
        optimizeDocConcentration=False, maxIter=math.ceil(passes / share), subsamplingRate=share, seed=seed,
    )
    return lda.fit(corpus.vectors)


def train_grid(corpus: Corpus, ks: Iterable[int] = range(15, 26), **settings) -> dict[int, LDAModel]:
    """One model per number of topics; the loop is over models, each fit is distributed."""
    return {k: train(corpus, k, **settings) for k in ks}


def topic_words(model: LDAModel, vocabulary: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the ``n`` heaviest words of each topic, rank from 0."""
    top = model.describeTopics(n)
    return (
        top.select("topic", F.posexplode_outer(F.arrays_zip("termIndices", "termWeights")).alias("rank", "_t"))
        .select("topic", "rank", F.col("_t.termIndices").alias("term_id"), F.col("_t.termWeights").alias("weight"))
        .join(vocabulary, "term_id")
        .select("topic", "rank", "term", "weight")
    )


def heaviest_words(weights: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight) of the ``n`` heaviest terms of each topic, ties by term, rank from 0."""
    top = top_per_group(weights, ["topic"], [F.desc("weight"), F.asc("term")], n, rank="rank")
    return top.select("topic", (F.col("rank") - 1).alias("rank"), "term", "weight")


def keywords(words: DataFrame) -> DataFrame:
    """(topic, Topic_Keywords): the words of each topic, heaviest first, joined by comma and space."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return words.groupBy("topic").agg(ordered.alias("_w")).select(
        "topic", F.array_join("_w.term", ", ").alias("Topic_Keywords")
    )


def document_topics(model: LDAModel, corpus: Corpus) -> DataFrame:
    """(key, topic_share array); a document without any vocabulary term has no shares (null)."""
    shares = vector_to_array("topicDistribution")
    return model.transform(corpus.vectors).select(
        corpus.key, F.when(F.exists(shares, lambda p: p > 0), shares).alias("topic_share"), "n_words"
    )


def dominant_topic(shares: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Per document the first topic with the largest share, that share to four digits, its keywords."""
    best = F.array_max("topic_share")
    picked = shares.select(
        key,
        (F.array_position("topic_share", best) - 1).cast("int").alias("Dominant_Topic"),
        F.round(best, 4).alias("Perc_Contribution"),
    )
    named = names.withColumnRenamed("topic", "Dominant_Topic")
    return picked.join(named, "Dominant_Topic", "left").select(
        key, "Dominant_Topic", "Perc_Contribution", "Topic_Keywords"
    )


def representative_documents(dominant: DataFrame, articles: DataFrame, key: str, title: str = "title") -> DataFrame:
    """Per topic the document with the largest share (first key wins ties) and its title.

    The titles are fetched for the chosen documents only, one per topic.
    """
    best = top_per_group(
        dominant.where(F.col("Dominant_Topic").isNotNull()),
        ["Dominant_Topic"], [F.desc("Perc_Contribution"), F.asc(key)], 1,
    )
    return articles.select(key, title).join(best, key).select(
        F.col("Dominant_Topic").alias("Repr_Dominant_Topic"),
        F.col("Perc_Contribution").alias("Repr_Perc_Contribution"),
        F.col("Topic_Keywords").alias("Repr_Topic_Keywords"),
        F.col(title).alias("Representative_Text"),
    )


def topic_articles(articles: DataFrame, dominant: DataFrame, representatives: DataFrame, key: str) -> DataFrame:
    """Articles with their topic and that topic's representative article, ordered by topic.

    Articles without a topic have no representative and drop out. ``representatives`` has one row per
    topic, so Catalyst broadcasts it.
    """
    same_topic = F.col("Dominant_Topic") == F.col("Repr_Dominant_Topic")
    return (
        articles.join(dominant, key).join(representatives, same_topic).orderBy("Dominant_Topic", key)
    )


def prevalence(shares: DataFrame) -> DataFrame:
    """(topic, share): how much of all text each topic covers, documents weighted by length."""
    rows = shares.select("n_words", F.posexplode("topic_share").alias("topic", "p"))
    weighted = rows.groupBy("topic").agg(F.sum(F.col("p") * F.col("n_words")).alias("_w"))
    total = shares.where(F.col("topic_share").isNotNull()).agg(F.sum("n_words")).scalar()
    return weighted.select("topic", (F.col("_w") / total).alias("share"))


def relevance(words: DataFrame, shares: DataFrame, weight: float = 0.6, n: int = 30) -> DataFrame:
    """The ``n`` most relevant terms per topic: ``w log p(t|topic) + (1 - w) log lift``.

    ``words`` is the whole (topic, term, weight) table of a model (``topic_words`` with the size of its
    vocabulary), which passes through the driver once when it is read from the model.
    """
    with_share = words.join(prevalence(shares), "topic")
    overall = with_share.groupBy("term").agg(F.sum(F.col("weight") * F.col("share")).alias("_p"))
    score = F.lit(weight) * F.log("weight") + F.lit(1 - weight) * F.log(F.col("weight") / F.col("_p"))
    scored = with_share.join(overall, "term").select("topic", "term", "share", score.alias("relevance"))
    return top_per_group(scored, ["topic"], [F.desc("relevance"), F.asc("term")], n, rank="rank")


def pick_model(scores: DataFrame) -> DataFrame:
    """(k, score, models): the best number of topics; the smallest one wins ties."""
    best = F.max_by("k", F.struct("score", -F.col("k")))
    return scores.agg(best.alias("k"), F.max("score").alias("score"), F.count(F.lit(1)).alias("models"))
