"""Dictionaries, positions and variational topic models."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newspulse.operators import dictionary as D
from newspulse.operators import variational as V
from newspulse.operators.numbering import consecutive, positional_join
from newspulse.session import stage


def docs_of(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id long, tokens array<string>").repartition(3)


def test_consecutive_numbers_with_ties_and_nulls(spark):
    rows = [(x,) for x in [5, 1, None, 5, 5, 2] * 50]
    got = consecutive(spark.createDataFrame(rows, "x int").repartition(7), [F.asc("x")], "n", start=1).collect()
    assert sorted(r.n for r in got) == list(range(1, 301))
    by_number = [r.x for r in sorted(got, key=lambda r: r.n)]
    assert by_number == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert consecutive(spark.createDataFrame([], "x int"), [F.asc("x")]).count() == 0


@pytest.mark.parametrize("how", ["inner", "outer"])
def test_positional_join(spark, how):
    a = spark.createDataFrame([(i, f"a{i}") for i in (3, 1, 2)], "i int, a string")
    b = spark.createDataFrame([(f"b{i}",) for i in range(5)], "b string").repartition(4)
    got = sorted((r.position, r.a, r.b) for r in positional_join(a, b, [F.desc("i")], [F.asc("b")], how).collect())
    want = [(0, "a3", "b0"), (1, "a2", "b1"), (2, "a1", "b2")]
    assert got == want + ([(3, None, "b3"), (4, None, "b4")] if how == "outer" else [])
    with pytest.raises(ValueError):
        positional_join(a, b, [F.asc("i")], [F.asc("b")], "left")


def test_dictionary_and_counts(spark):
    draw = random.Random(2)
    lists = [[draw.choice("abcdefgh") * draw.randint(1, 2) for _ in range(draw.randint(0, 30))] for _ in range(40)] + [[], ["", "zz"]]
    docs = docs_of(spark, lists)
    terms = D.dictionary(docs, prune=False)
    ids = {r.term: r.term_id for r in terms.collect()}
    words = sorted({w for t in lists for w in t if w})
    assert ids == {w: i for i, w in enumerate(words)}
    want = {(i, ids[w]): t.count(w) for i, t in enumerate(lists) for w in t if w}
    for hot in (0, 1, 4096):
        counts = D.term_counts(docs, "id", terms, hot=hot)
        assert {(r.id, r.term_id): r.n for r in counts.collect()} == want
    for r in D.sparse_vectors(D.term_counts(docs, "id", terms), "id").collect():
        assert r.ids == sorted(r.ids) and {(r.id, i): n for i, n in zip(r.ids, r.counts)} == {k: n for k, n in want.items() if k[0] == r.id}
    few = D.dictionary(docs, no_below=15, no_above=0.5)
    df = {w: sum(w in t for t in lists) for w in words}
    assert {r.term: (r.term_id, r.df) for r in few.collect()} == {
        w: (i, df[w]) for i, w in enumerate(w for w in words if 15 <= df[w] <= 21)}
    assert D.dictionary(docs_of(spark, [[]])).count() == 0


def test_special_functions():
    x = np.array([0.01, 0.5, 1.0, 2.5, 7.0, 150.0])
    h = 1e-5
    slope = (V.log_gamma(x + h * x) - V.log_gamma(x - h * x)) / (2 * h * x)
    assert V.digamma(x) == pytest.approx(slope, rel=1e-6, abs=1e-6)
    assert V.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-9)
    assert V.trigamma(np.array([1.0, 0.5])) == pytest.approx([math.pi ** 2 / 6, math.pi ** 2 / 2], abs=1e-7)


def test_prior_steps_find_the_prior():
    draw = np.random.default_rng(3)
    true = np.array([0.3, 1.5, 4.0])
    logs = np.log(draw.dirichlet(true, 20000) + 1e-300).mean(0)
    prior = np.ones(3)
    for _ in range(100):
        prior = V.better_prior(prior, logs, 20000, 0.5)
    assert prior == pytest.approx(true, rel=0.05)


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(5)
    lists = [[f"t{i % 3}w{draw.randint(0, 9)}" if draw.random() < 0.8 else f"n{draw.randint(0, 30)}" for _ in range(30)] for i in range(120)]
    docs = stage(docs_of(spark, lists), "docs")
    terms = D.dictionary(docs, no_below=1, no_above=1.0)
    return docs, terms


def test_batches_hold_each_document_once(planted):
    docs, terms = planted
    batches = V.deal(docs, "id", terms, 4)
    assert batches.vectors.count() == batches.n_docs == 120 and batches.vectors.select("id").distinct().count() == 120
    assert batches.vectors.select("batch").distinct().count() <= 4


def test_planted_topics_are_found_and_the_bound_grows(planted):
    docs, terms = planted
    batches = V.deal(docs, "id", terms, 1)
    model = V.fit(batches, 3, passes=5, decay=0.0, learn_alpha=False)
    bounds = [h["bound"] for h in model.history]
    assert all(b > a - abs(a) * 1e-6 for a, b in zip(bounds[1:], bounds[2:]))
    assert all((h["docs"], h["words"], h["converged"]) == (120, 3600, 120) for h in model.history)
    shares = {r.id: r.topic_share for r in model.document_topics(batches.vectors, "id").collect()}
    found = {i: int(np.argmax(s)) for i, s in shares.items()}
    assert len(found) == 120 and all(sum(s) == pytest.approx(1) for s in shares.values())
    assert all(found[i] == found[i % 3] for i in found) and len({found[0], found[1], found[2]}) == 3
    words = {}
    for r in model.topic_words(terms, 10).collect():
        words.setdefault(r.topic, set()).add(r.term)
    assert words == {found[t]: {f"t{t}w{i}" for i in range(10)} for t in range(3)}


def test_learned_priors_and_small_batches(planted):
    docs, terms = planted
    model = V.fit(V.deal(docs, "id", terms, 3), 3, passes=3, learn_eta=True)
    assert (model.alpha > 0).all() and len(set(model.alpha)) > 1 and model.eta > 0
    assert model.history[-1]["perplexity"] < model.history[0]["perplexity"]


def test_a_restarted_grid_fits_only_what_is_missing(spark, planted, tmp_path, monkeypatch):
    docs, terms = planted
    batches, fitted, real = V.deal(docs, "id", terms, 2), [], V.fit
    monkeypatch.setattr(V, "fit", lambda b, k, **s: fitted.append(k) or real(b, k, **s))
    first = V.fit_grid(batches, [2, 3], str(tmp_path), at_once=2, passes=1)
    again = V.fit_grid(batches, [2, 3, 4], str(tmp_path), passes=1)
    assert sorted(fitted) == [2, 3, 4] and list(again) == [2, 3, 4]
    for k in (2, 3):
        assert np.array_equal(first[k].weights, again[k].weights) and np.array_equal(first[k].alpha, again[k].alpha)
        assert first[k].history == again[k].history and first[k].eta == again[k].eta
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_no_terms_is_an_error(spark):
    docs = docs_of(spark, [[], []])
    with pytest.raises(ValueError):
        V.fit(V.deal(docs, "id", D.dictionary(docs, prune=False), 2), 2)


def test_documents_side_by_side_get_what_each_gets_alone(monkeypatch):
    calls, real = [], V.log_share
    rng = np.random.default_rng(4)
    words, alpha = np.exp(real(rng.random((4, 60)) ** 4 * 90 + 0.1)), np.array([0.3, 0.1, 0.2, 0.05])
    lengths = np.array([*rng.integers(1, 30, 400), 0])
    ids = np.concatenate([rng.choice(60, n, replace=False) for n in lengths]).astype(int)
    counts = rng.integers(1, 5, len(ids)).astype(float)
    monkeypatch.setattr(V, "log_share", lambda w: calls.append(1) or real(w))
    gamma, parts, converged = V.fit_shares(ids, counts, lengths, words, alpha, 60, 0.001)
    assert len(calls) <= 62  # as many steps as the slowest document needs, not a sum over documents
    assert not converged.all() and converged.any()
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip(ends - lengths, ends)):
        own, beta = np.full(4, counts[a:b].sum() / 4) + alpha, words[:, ids[a:b]]
        done = False
        for _ in range(60):
            theta, last = np.exp(real(own)), own
            own = alpha + theta * (beta @ (counts[a:b] / (theta @ beta + 1e-100)))
            if np.abs(own - last).mean() < 0.001:
                done = True
                break
        theta = np.exp(real(own))
        assert gamma[:, i] == pytest.approx(own, rel=1e-9) and converged[i] == done
        assert parts[:, a:b] == pytest.approx(theta[:, None] * beta * (counts[a:b] / (theta @ beta + 1e-100)), rel=1e-9)


def test_blocks_hold_every_document_whatever_its_size(monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 5)
    sizes = [3, 2, 1, 9, 0, 4, 0, 5]
    lists = [list(range(n)) for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([[7, 8], *lists]), pa.array([[1, 1], *lists])], ["k", "ids", "counts"])
    got = [(first, end, ids.tolist(), lengths.tolist()) for first, end, ids, _, lengths in V._blocks(batch.slice(1))]
    assert [n for *_, here in got for n in here] == sizes
    assert [i for _, _, ids, _ in got for i in ids] == sum(lists, [])
    assert [first for first, *_ in got] == [0, *[end for _, end, *_ in got[:-1]]]
    assert all(len(ids) <= 5 or len(lengths) == 1 for _, _, ids, lengths in got)
