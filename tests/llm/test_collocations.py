"""Phrase collocations against a plain count of all runs of words."""

import collections
import re

import pytest
from test_llm_operators import empty, odd  # noqa: F401

from newspulse.llm import collocations
from newspulse.llm.collocations import collocations as collocated

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                count.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    often = {k: a for k, a in count.items() if a >= least}
    kept = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        longer = [b for (m, q), b in often.items() if m == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = count[lang, p[:k]], count[lang, p[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        kept[lang].append((-score, -a, " ".join(p).encode(), left, right))
    out = set()
    for lang, found in kept.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def rows_of(df):
    assert df.columns == COLUMNS
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


TEXTS = [
    ("en", "New  York\tCity is big. new york city, NEW YORK CITY; new york! York city? the the the the"),
    ("en", "a b a b a b a b. a\nb a\x0bb\x0ca b \x85 b é è é è"),
    (None, "Östlich ÖSTLICH a b c a b c a b c: \U0001f600 \U0001f600 \U0001f600 x"),
    ("de", "new york new york " * 5 + "."), ("de", None), ("de", ""), ("", " \t\n.,;"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS * 4, "lang string, text string").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"bits": 6}, {"table_bits": 15}, {"bits": 3, "table_bits": 15}])
def test_short_fingerprints_and_small_tables_change_nothing(texts, sizes):
    assert rows_of(collocated(texts, **{"table_bits": 20, **sizes})) == brute(TEXTS * 4)


def test_ranks_stop_at_the_top(texts):
    assert rows_of(collocated(texts, least=2, top=3, table_bits=18)) == brute(TEXTS * 4, 2, 3)


def test_batches_and_partitions_do_not_matter(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH", 60)
    assert rows_of(collocated(texts.repartition(7), table_bits=18)) == brute(TEXTS * 4)


def test_odd_rows(odd, empty):  # noqa: F811
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert rows_of(collocated(odd, table_bits=20)) == brute(rows)
    assert rows_of(collocated(empty, table_bits=15)) == set()
    names = odd.withColumnsRenamed({"text": "body", "lang": "row"}).withColumnRenamed("stats", "text")
    assert rows_of(collocated(names, text="body", lang="row", table_bits=20)) == brute(rows)


def test_a_hot_phrase_is_counted_whole(spark):
    rows = [("en", "one hot phrase")] * 3000 + [("en", f"one cold{i} phrase") for i in range(30)]
    got = rows_of(collocated(spark.createDataFrame(rows, "lang string, text string").repartition(8), table_bits=18))
    assert got == brute(rows)


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 9), (10, 10, 10)], "a long, l long, r long")
    got = [r[0] for r in df.select(collocations.score("a", "l", "r")).collect()]
    assert got == [10**6 * (10**13 + 7) ** 2 // ((3 * 10**13 + 1) * (2 * 10**13 + 9)), 10**6]
