"""Suffix arrays and the removal of repeated strings against plain sorting and counting."""

import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm_operators import empty, odd  # noqa: F401

from newspulse.llm import suffix_dedup
from newspulse.llm.suffix_dedup import lyndon_groups, remove_repeats, repeated_windows, suffix_array


def plain(text):
    return sorted(range(len(text) + 1), key=lambda i: text[i:])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.lists(st.sampled_from([97, 98]), max_size=80).map(bytes)))
def test_suffix_array_is_the_order_of_the_suffixes(text):
    assert suffix_array(text) == plain(text)


@pytest.mark.parametrize("text", [b"", b"a", b"a" * 700, b"ab" * 300, b"aab" * 200, bytes(range(256)) * 2, b"\x00" * 9 + b"\xff" * 9])
def test_suffix_array_of_periodic_texts(text):
    assert suffix_array(text) == plain(text)


def test_groups_are_lyndon_prefixes():
    text = b"graindraining"
    group, prev = lyndon_groups(text)
    order = {i: r for r, i in enumerate(plain(text))}
    for i in range(len(text)):
        # The Lyndon prefix ends where the next smaller suffix begins.
        end = next(j for j in range(i + 1, len(text) + 1) if order[j] < order[i])
        same = [j for j in range(len(text)) if group[j] == group[i]]
        for j in same:
            assert text[j:j + end - i] == text[i:end]
        assert prev[i] == max([j for j in range(i) if group[j] < group[i]], default=-1)


def covered(texts, length):
    seen = collections.Counter(d[i:i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for d in texts:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(d):
            j = i
            while j < len(d) and mark[j] == mark[i]:
                j += 1
            spans += [(i, j)] if mark[i] else []
            i = j
        out.append((len(d), spans, bytes(c for c, m in zip(d, mark) if not m)))
    return out


def run(df, length, **more):
    rows = remove_repeats(df, length, **more).collect()
    return {r[0]: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows}


def check(spark, texts, length, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = covered([(t or "").encode() for t in texts], length)
    assert run(df, length, **more) == dict(enumerate(want))


def made(seed, letters, n=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
    passages = [" ".join(word() for _ in range(draw.randint(3, 12))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [draw.choice(passages) if draw.random() < 0.4 else word() for _ in range(draw.randint(0, 12))]
        texts.append(" ".join(parts))
    return texts


def test_windows_repeated_in_a_group():
    pieces = [b"xabcdefy", b"zabcdefw", b"abcd", b"qqqqq"]
    got = [f.tolist() for f in repeated_windows(pieces, 4)]
    assert got == [[False, True, True, True, False], [False, True, True, True, False], [True], [True, True]]


@pytest.mark.parametrize("length", [1, 2, 7, 20])
@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz", "aé日\U0001f600"])
def test_removed_bytes_are_those_of_repeated_strings(spark, length, letters):
    texts = made(length, letters)
    check(spark, [*texts, texts[0], "", None, "a" * 50, "ab" * 30, "x"], length)


def test_large_groups_give_the_same(spark):
    passage = "the shared passage of many documents, word for word. "
    texts = [f"{i} before {passage} after {i * 7}" for i in range(80)] + [passage * 3]
    check(spark, texts, 30, group=4)
    check(spark, texts, 30)


def test_long_texts_are_cut_at_no_place_that_matters(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 64)
    texts = made(9, "abc", 30)
    check(spark, [" ".join(texts), *texts, "ab" * 200], 20)


def test_odd_rows(spark, odd, empty):  # noqa: F811
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    want = sorted((str(k), *map(str, w)) for (k, _), w in zip(texts, covered([t for _, t in texts], 40)))
    got = remove_repeats(odd, 40)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert want == sorted((str(r["doc_id"]), str(r["n_bytes"]), str([tuple(s) for s in r["spans"]]), str(bytes(r["kept"]))) for r in got.collect())
    assert remove_repeats(empty, 40).count() == 0
    big = odd.where("doc_id = 100").withColumn("doc_id", F.lit(9007199254740993))
    assert remove_repeats(big.unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), 400).where("doc_id = 9007199254740993").count() == 1
