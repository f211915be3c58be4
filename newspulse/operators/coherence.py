"""Topic coherence ``c_v``: word co-occurrence in sliding windows, NPMI vectors, cosine.

A word is in window ``i`` of a text when it stands within the ``window`` tokens that start at ``i``. An
occurrence at position ``p`` therefore covers a run of window numbers. Runs are counted as intervals;
the windows themselves are never listed, so the work grows with the occurrences of the topics' words
and not with occurrences x window size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newspulse.functions.rows import small_table
from newspulse.session import stage

EPSILON = 1e-12


def occurrences(df: DataFrame, key: str, tokens: str, listed: list[str]) -> DataFrame:
    """(key, size, p, term): where the listed words stand, and the first token of every text whatever it is.

    The only pass over the corpus, staged for the many small steps that follow. The first tokens stand for
    their texts when windows are counted, so texts without any listed word are not forgotten.
    """
    sized = df.select(key, tokens, F.size(tokens).alias("size"))
    rows = sized.select(key, "size", F.posexplode_outer(tokens).alias("p", "term"))
    wanted = F.col("term").isin(listed) | F.coalesce(F.col("p") == 0, F.lit(True))
    return stage(rows.where(wanted), "occurrences")


def _coverage(at: DataFrame, key: str, listed: list[str], window: int) -> DataFrame:
    """(key, block, term, lo, hi): disjoint runs of window numbers that contain the term.

    Runs are cut at multiples of ``window`` so that two terms can be matched by block.
    """
    last = F.greatest(F.col("size") - window, F.lit(0))
    at = at.where(F.col("term").isin(listed)).select(
        key, "term", "p",
        F.greatest(F.col("p") - (window - 1), F.lit(0)).alias("lo"),
        F.least(F.col("p"), last).alias("hi"),
    )
    # Earlier occurrences of the same term already cover the windows up to their own "hi".
    before = Window.partitionBy(key, "term").orderBy("p")
    fresh = at.withColumn("lo", F.greatest("lo", F.coalesce(F.lag("hi").over(before) + 1, F.lit(0))))
    runs = fresh.where(F.col("lo") <= F.col("hi"))
    first, final = F.floor(F.col("lo") / window), F.floor(F.col("hi") / window)
    blocks = runs.select(key, "term", "lo", "hi", F.explode(F.sequence(first, final)).alias("block"))
    return blocks.select(
        key, "block", "term",
        F.greatest("lo", F.col("block") * window).alias("lo"),
        F.least("hi", (F.col("block") + 1) * window - 1).alias("hi"),
    )


def window_counts(
    at: DataFrame, key: str, words: DataFrame, listed: list[str], window: int = 110
) -> tuple[DataFrame, DataFrame]:
    """(term, n) and (a, b, n): windows that hold a topic word, or both words of a pair of one topic.

    Pairs come from the topics' own word lists (a few hundred rows), a < b.
    """
    cover = _coverage(at, key, listed, window)
    single = cover.groupBy("term").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
    one, two = words.select("topic", F.col("term").alias("a")), words.select("topic", F.col("term").alias("b"))
    pairs = one.join(two, "topic").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    left = cover.select(key, "block", F.col("term").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = cover.select(key, "block", F.col("term").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    shared = F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b") + 1
    both = (
        left.join(pairs, "a").join(right, [key, "block", "b"])
        .where(shared > 0)
        .groupBy("a", "b")
        .agg(F.sum(shared).alias("n"))
    )
    return single, both


def total_windows(at: DataFrame, window: int = 110) -> DataFrame:
    """One row: the number of windows; a text shorter than the window is one window."""
    texts = at.where(F.coalesce(F.col("p") == 0, F.lit(True)))
    size = F.greatest(F.col("size") - window + 1, F.lit(1))
    return texts.agg(F.sum(size).cast("double").alias("windows"))


def topic_coherence(
    df: DataFrame, key: str, tokens: str, words: DataFrame, window: int = 110
) -> DataFrame:
    """(topic, coherence) for ``words`` = (topic, term): mean cosine of each word's NPMI vector with the
    topic's summed vector. Everything after the two counts has the size of the word lists."""
    # The word lists enter the plan many times and have the size of the models' top words, not of the
    # corpus: fetched once, they become a local relation.
    words = words.select("topic", "term").distinct()
    words = small_table(df.sparkSession, [tuple(r) for r in words.collect()], words.schema)
    listed = sorted({r["term"] for r in words.collect()})
    at = occurrences(df, key, tokens, listed)
    single, both = window_counts(at, key, words, listed, window)
    n = F.lit(total_windows(at, window).scalar())
    p = words.join(single, "term", "left").select("topic", "term", (F.coalesce("n", F.lit(0)) / n).alias("p"))
    mirrored = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    joint = mirrored.select("a", "b", (F.col("n") / n).alias("p_ab"))
    a = p.select("topic", F.col("term").alias("a"), F.col("p").alias("p_a"))
    b = p.select("topic", F.col("term").alias("b"), F.col("p").alias("p_b"))
    p_ab = F.when(F.col("a") == F.col("b"), F.col("p_a")).otherwise(F.coalesce("p_ab", F.lit(0.0)))
    grid = a.join(b, "topic").join(joint, ["a", "b"], "left").withColumn("p_ab", p_ab)
    joint_e = F.col("p_ab") + EPSILON
    pmi = F.log(joint_e / (F.col("p_a") * F.col("p_b")))
    # A word that never occurs says nothing about its neighbours.
    npmi = F.when(F.col("p_a") * F.col("p_b") > 0, pmi / -F.log(joint_e)).otherwise(0.0)
    vectors = grid.select("topic", "a", "b", npmi.alias("x"))
    summed = vectors.groupBy("topic", "b").agg(F.sum("x").alias("s"))
    lengths = vectors.join(summed, ["topic", "b"]).groupBy("topic", "a").agg(
        F.sum(F.col("x") * F.col("s")).alias("dot"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len_x"),
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("len_s"),
    )
    size = F.col("len_x") * F.col("len_s")
    cosine = F.when(size > 0, F.col("dot") / size).otherwise(0.0)
    return lengths.groupBy("topic").agg(F.avg(cosine).alias("coherence"))


def model_coherence(
    df: DataFrame, key: str, tokens: str, words: DataFrame, window: int = 110
) -> DataFrame:
    """(model, score): mean topic coherence per model for ``words`` = (model, topic, term).

    All models are scored in one pass over the corpus: their topics are told apart by (model, topic).
    """
    named = words.select(F.struct("model", "topic").alias("topic"), "term")
    scored = topic_coherence(df, key, tokens, named, window)
    return scored.groupBy(F.col("topic.model").alias("model")).agg(F.avg("coherence").alias("score"))
