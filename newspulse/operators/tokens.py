"""Token tables: topic tokens, word classes, term and document frequencies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.functions import text as X
from newspulse.functions.rows import exploded


def without_words(tokens: Column, words: Iterable[str]) -> Column:
    """Drop the listed words from a token array, order and repeats kept.

    A long ``IN`` list becomes one hash set inside the expression, so nothing is exploded or joined.
    """
    listed = sorted(set(words))
    return F.filter(tokens, lambda t: ~t.isin(listed)) if listed else tokens


def topic_tokens(
    df: DataFrame,
    text_col: str,
    stopwords: Iterable[str],
    dropped_classes: Iterable[str] = (),
    out: str = "tokens",
) -> DataFrame:
    """Add the topic-model tokens of a text column.

    ``dropped_classes`` lists the words that a word-class list marks as neither noun nor verb; words
    unknown to the list count as nouns and stay.
    """
    unwanted = set(stopwords) | set(dropped_classes)
    return df.withColumn(out, without_words(X.topic_words(text_col), unwanted))


def keep_word_classes(
    df: DataFrame,
    key: str,
    pos_lexicon: DataFrame,
    tokens: str = "tokens",
    allowed: Iterable[str] = ("n", "v"),
    default: str = "n",
) -> DataFrame:
    """(key, tokens) with only the words of the allowed classes; unknown words have class ``default``.

    ``pos_lexicon`` is (word, pos), one row per word. For word-class tables too large for an ``IN`` list. Catalyst broadcasts the table if its size
    allows; otherwise the skewed token side of the join is split at run time.
    """
    lexicon = pos_lexicon.withColumnRenamed("pos", "_class")
    words = df.select(key, F.posexplode_outer(tokens).alias("_pos", "word"))
    kept = F.coalesce("_class", F.lit(default)).isin(list(allowed)) & F.col("word").isNotNull()
    return (
        words.join(lexicon, "word", "left")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.when(kept, F.struct("_pos", "word")))).alias("_kept"))
        .select(key, F.col("_kept.word").alias(tokens))
    )


def document_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Documents per term. Repeats are removed inside the row, so one partial count per task is shuffled."""
    return (
        exploded(df, [], F.array_distinct(tokens), "term")
        .where(F.col("term") != "")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def pruned_vocabulary(
    df: DataFrame, tokens: str = "tokens", no_below: int = 10, no_above: float = 0.35
) -> DataFrame:
    """Terms in at least ``no_below`` documents and at most the share ``no_above`` of all documents."""
    total = df.agg(F.count(F.lit(1))).scalar()
    kept = (F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above) * total)
    return document_frequency(df, tokens).where(kept)


def bag_of_words(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Long form (key, term, n); never one column per term."""
    return (
        exploded(df, [key], tokens, "term")
        .where(F.col("term") != "")
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
