"""Dictionary of a corpus as a table: no vocabulary on the driver or in a task, whatever its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.operators.numbering import consecutive
from newspulse.operators.tokens import bag_of_words, document_frequency, pruned_vocabulary

HOT = 4096  # most frequent terms that are broadcast; all others are joined by a shuffle


def dictionary(
    df: DataFrame, tokens: str = "tokens", no_below: int = 10, no_above: float = 0.35, prune: bool = True,
) -> DataFrame:
    """(term_id, term, df): consecutive ids from 0 in the order of the terms, stored.

    ``prune=False`` keeps every term; else the bounds on document frequency decide. ``df`` is read twice with
    bounds: stage it first when its tokens are expensive.
    """
    kept = pruned_vocabulary(df, tokens, no_below, no_above) if prune else document_frequency(df, tokens)
    return consecutive(kept, [F.asc("term")], "term_id").select("term_id", "term", "df")


def term_counts(df: DataFrame, key: str, terms: DataFrame, tokens: str = "tokens", hot: int = HOT) -> DataFrame:
    """(key, term_id, n) of the terms of a dictionary. ``key`` must be unique.

    The ``hot`` most frequent terms meet their rows where these are, so the words that fill most texts are never
    shuffled to one place; the long tail is joined by a shuffle.
    """
    counts = bag_of_words(df, key, tokens)
    most = terms.orderBy(F.desc("df"), "term").limit(hot).select("term", F.col("term_id").alias("_hot"))
    marked = counts.join(F.broadcast(most), "term", "left")  # at most ``hot`` rows
    common = marked.where(F.col("_hot").isNotNull()).select(key, F.col("_hot").alias("term_id"), "n")
    rare = marked.where(F.col("_hot").isNull()).select(key, "term", "n").join(terms.select("term", "term_id"), "term")
    return common.unionByName(rare.select(key, "term_id", "n"))


def sparse_vectors(counts: DataFrame, key: str) -> DataFrame:
    """(key, ids, counts): term ids of each document in ascending order and how often each occurs."""
    pairs = F.array_sort(F.collect_list(F.struct("term_id", "n")))
    rows = counts.groupBy(key).agg(pairs.alias("_p"))
    return rows.select(key, F.col("_p.term_id").alias("ids"), F.col("_p.n").alias("counts"))
