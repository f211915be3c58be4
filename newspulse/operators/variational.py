"""Topic models by variational Bayes over stored mini-batches, every document once in each pass.

Documents are dealt once into disjoint batches, which are stored. In a pass each batch is read once: tasks fit
the topic shares of its documents to convergence and return sums per term, the driver blends them into the
topics. What passes through the driver is as large as the model (topics x terms), never as the corpus.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newspulse.operators import dictionary as D
from newspulse.session import path_exists, stage

SAMPLE = 512  # documents that the first topics are chosen from
BLOCK = 1 << 14  # terms of the documents that a task fits side by side


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function, for positive values."""
    x, low = np.array(x, float), np.zeros_like(x, float)
    for _ in range(6):
        small = x < 6
        low -= np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of the logarithm of the gamma function, for positive values."""
    x, low = np.array(x, float), np.zeros_like(x, float)
    for _ in range(6):
        small = x < 6
        low += np.where(small, 1 / (x * x), 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return low + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def log_share(weights: np.ndarray) -> np.ndarray:
    """Expected logarithms of the shares of a Dirichlet distribution, along the last axis."""
    return digamma(weights) - digamma(weights.sum(-1, keepdims=True))


def better_prior(prior: np.ndarray, mean_log: np.ndarray, n: float, step: float) -> np.ndarray:
    """A Newton step of a Dirichlet prior towards ``n`` observed mean logarithms, halved until it stays positive."""
    gradient = n * (digamma(prior.sum()) - digamma(prior) + mean_log)
    diagonal = -n * trigamma(prior)
    shared = n * trigamma(prior.sum())
    b = (gradient / diagonal).sum() / (1 / shared + (1 / diagonal).sum())
    towards = (gradient - b) / diagonal
    for _ in range(20):
        moved = prior - step * towards
        if np.isfinite(moved).all() and (moved > 1e-6).all():
            return moved
        step /= 2
    return prior


@dataclass
class Model:
    """Topic weights (topics x terms), the priors and what each pass reached."""

    weights: np.ndarray
    alpha: np.ndarray
    eta: float
    history: list[dict] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.weights)

    def topic_words(self, terms: DataFrame, n: int = 10) -> DataFrame:
        """(topic, rank, term, weight): the ``n`` heaviest words of each topic, rank from 0, ties by term id."""
        shares = self.weights / self.weights.sum(1, keepdims=True)
        rows = [
            (t, rank, int(i), float(shares[t, i]))
            for t in range(self.k) for rank, i in enumerate(np.argsort(-shares[t], kind="stable")[:n])]
        listed = terms.sparkSession.createDataFrame(rows, "topic int, rank int, term_id long, weight double")
        return listed.join(terms.select("term_id", "term"), "term_id").select("topic", "rank", "term", "weight")

    def document_topics(self, vectors: DataFrame, key: str) -> DataFrame:
        """(key, topic_share, n_words): the shares of every document with a term of the dictionary."""
        out = _fitted(vectors.select(key, "ids", "counts"), _shared(vectors.sparkSession, self), stats=False)
        return out.select(F.col("_key").cast(vectors.schema[key].dataType).alias(key), "topic_share", "n_words")

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row per topic."""
        meta = json.dumps({"eta": self.eta, "history": self.history})
        rows = [(t, self.weights[t].tolist(), float(self.alpha[t]), meta) for t in range(self.k)]
        spark.createDataFrame(rows, "topic int, weights array<double>, alpha double, meta string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).orderBy("topic").collect()
        meta = json.loads(rows[0]["meta"])
        return cls(np.array([r["weights"] for r in rows]), np.array([r["alpha"] for r in rows]), meta["eta"], meta["history"])


def _each(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the columns of ``values`` document by document; ``lengths`` says how many columns each has."""
    some = lengths > 0
    out = np.zeros((len(values), len(lengths)))
    if some.any():
        out[:, some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some], axis=1)
    return out


def fit_shares(
    ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, words: np.ndarray, alpha: np.ndarray, iterations: int,
    tolerance: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights of the topics in each document, share of the terms' counts by topic, which documents converged).

    The documents of a block are fitted side by side: ``ids`` and ``counts`` hold the terms of one after the other,
    ``lengths`` how many each has; in the results topics are rows. ``words`` is exp of the expected log shares of
    words, topics x terms. Each document stops by itself when its weights move by less than ``tolerance`` on
    average; those that go on are packed together from time to time.
    """
    beta = words[:, ids]
    gammas = _each(counts[None], lengths) / len(alpha) + alpha[:, None]
    converged = np.zeros(len(lengths), bool)
    at, size, part, n, gamma = np.arange(len(lengths)), lengths, beta, counts, gammas.copy()
    going = np.ones(len(at), bool)
    theta = np.exp(log_share(gamma.T)).T
    for _ in range(iterations):
        if not going.any():
            break
        if going.sum() < 0.7 * len(going):
            terms = np.repeat(going, size)
            at, size, part, n = at[going], size[going], part[:, terms], n[terms]
            gamma, theta, going = gamma[:, going], theta[:, going], np.ones(int(going.sum()), bool)
        norm = (np.repeat(theta, size, axis=1) * part).sum(0) + 1e-100
        last, gamma = gamma, alpha[:, None] + theta * _each(part * (n / norm), size)
        theta = np.exp(log_share(gamma.T)).T
        gammas[:, at[going]] = gamma[:, going]
        done = going & (np.abs(gamma - last).mean(0) < tolerance)
        converged[at[done]] = True
        going &= ~done
    weighted = np.repeat(np.exp(log_share(gammas.T)).T, lengths, axis=1) * beta
    return gammas, weighted * (counts / (weighted.sum(0) + 1e-100)), converged


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, end, ids, counts, lengths) of consecutive documents that hold about ``BLOCK`` terms, one at least."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
    ids = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    counts = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
        here = slice(ends[first], ends[end])
        yield first, end, ids[here], counts[here], np.diff(ends[first:end + 1])
        first = end


STATS = "term_id long, sums array<double>, share_logs array<double>, bound double, words double, docs long, converged long"
SHARES = "_key string, topic_share array<double>, n_words long"


def _shared(spark: SparkSession, model: Model) -> Broadcast:
    """What tasks need of a model, as large as the model."""
    return spark.sparkContext.broadcast((np.exp(log_share(model.weights)), model.alpha))


def _fitted(vectors: DataFrame, shared: Broadcast, stats: bool, iterations: int = 400, tolerance: float = 0.001) -> DataFrame:
    """Either the shares of each document, or sums per term and one row of totals from each task."""
    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, alpha = shared.value
        for batch in batches:
            for first, end, ids, counts, lengths in _blocks(batch):
                gamma, _, _ = fit_shares(ids, counts, lengths, words, alpha, iterations, tolerance)
                found = np.ravel((gamma / gamma.sum(0)).T)
                each = pa.ListArray.from_arrays(np.arange(0, len(found) + 1, len(alpha), dtype=np.int32), found)
                n_words = _each(counts[None], lengths)[0].astype(np.int64)
                columns = [batch.column(0).slice(first, end - first), each, pa.array(n_words)]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "topic_share", "n_words"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, alpha = shared.value
        total, logs, bound, n_words, docs, done = np.zeros_like(words), np.zeros(len(alpha)), 0.0, 0.0, 0, 0
        for batch in batches:
            for _, _, ids, n, lengths in _blocks(batch):
                gamma, parts, converged = fit_shares(ids, n, lengths, words, alpha, iterations, tolerance)
                seen, places = np.unique(ids, return_inverse=True)
                total[:, seen] += [np.bincount(places, p, len(seen)) for p in parts]
                log = log_share(gamma.T).T
                logs += log.sum(1)
                bound += float(n @ np.log((np.repeat(np.exp(log), lengths, axis=1) * words[:, ids]).sum(0) + 1e-100))
                bound += float(((alpha[:, None] - gamma) * log).sum() + log_gamma(gamma).sum() - log_gamma(gamma.sum(0)).sum())
                bound += len(lengths) * (math.lgamma(alpha.sum()) - float(log_gamma(alpha).sum()))
                n_words, docs, done = n_words + n.sum(), docs + len(lengths), done + int(converged.sum())
        used = np.flatnonzero(total.any(0))
        rows = [(int(i), total[:, i].tolist(), None, None, None, None, None) for i in used]
        rows.append((None, None, logs.tolist(), bound, float(n_words), docs, done))
        kinds = pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64(), pa.int64()
        names = [c.split()[0] for c in STATS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    named = vectors.select(F.col(vectors.columns[0]).cast("string"), "ids", "counts")
    return named.mapInArrow(sums if stats else shares, STATS if stats else SHARES)


@dataclass
class Batches:
    """A corpus dealt into stored, disjoint batches."""

    vectors: DataFrame  # key, ids, counts, batch
    n_batches: int
    n_docs: int
    n_terms: int
    key: str
    terms: DataFrame


def deal(docs: DataFrame, key: str, terms: DataFrame, n_batches: int = 8, tokens: str = "tokens") -> Batches:
    """Sparse vectors of all documents that hold a term, each in one of ``n_batches`` stored batches by its key.

    The number of batches, and with it the number of steps of a pass, does not grow with the corpus; a batch does.
    """
    vectors = D.sparse_vectors(D.term_counts(docs, key, terms, tokens), key)
    vectors = vectors.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n_batches)).cast("int"))
    stored = stage(vectors, "batches", "batch")
    return Batches(stored, n_batches, stored.count(), terms.count(), key, terms)


def _first_topics(batches: Batches, k: int, eta: float) -> np.ndarray:
    """Topics that begin as documents far apart: each the least like those before it, of a bounded sample."""
    order = [F.xxhash64(batches.key), F.col(batches.key)]
    rows = batches.vectors.orderBy(*order).limit(SAMPLE).select("ids", "counts").collect()
    sample = np.zeros((len(rows), batches.n_terms))
    for i, r in enumerate(rows):
        sample[i, r["ids"]] = r["counts"]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = [int(sample.sum(1).argmax())]
    while len(chosen) < min(k, len(rows)):
        like = (unit @ unit[chosen].T).max(1)
        like[chosen] = np.inf
        chosen.append(int(like.argmin()))
    chosen += [chosen[i % len(chosen)] for i in range(k - len(chosen))]
    ramp = 1 + 0.01 * np.arange(k)[:, None]  # tells equal beginnings apart
    per_topic = batches.n_docs / k / sample[chosen].sum(1, keepdims=True) * sample.sum(1).mean()
    return eta + sample[chosen] * np.minimum(per_topic, 100) * ramp + 0.1


def fit(
    batches: Batches, k: int, passes: int = 10, eta: float = 0.01, alpha: float | None = None, learn_alpha: bool = True,
    learn_eta: bool = False, offset: float = 1.0, decay: float = 0.5, iterations: int = 400, tolerance: float = 0.001,
) -> Model:
    """``passes`` sweeps over all batches, each document read once in each.

    After every batch the topics move towards its sums, scaled to the corpus, by (``offset`` + steps)^-``decay``;
    with one batch and ``decay`` 0 this is plain batch inference. ``alpha`` (1 / k by default) is learned as an
    asymmetric prior, ``eta`` as a symmetric one if asked for. ``history`` has one entry per pass: the variational
    bound (of the topics that the pass began with, and of its documents as they were read), words, perplexity, documents and how many of them converged within ``iterations``.
    """
    if not batches.n_docs:
        raise ValueError("no document holds a term")
    model = Model(_first_topics(batches, k, eta), np.full(k, alpha or 1 / k), eta)
    spark, step = batches.vectors.sparkSession, 0
    for number in range(passes):
        seen = {"bound": 0.0, "words": 0.0, "docs": 0, "converged": 0}
        log = log_share(model.weights)
        topics = float(((model.eta - model.weights) * log).sum() + log_gamma(model.weights).sum() - log_gamma(model.weights.sum(1)).sum())
        topics += k * (math.lgamma(model.eta * batches.n_terms) - batches.n_terms * math.lgamma(model.eta))
        for batch in range(batches.n_batches):
            part = batches.vectors.where(F.col("batch") == batch).select(batches.key, "ids", "counts")
            shared = _shared(spark, model)
            rows = _fitted(part, shared, True, iterations, tolerance)
            summed = rows.groupBy("term_id").agg(
                F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(k)]).alias("sums"),
                F.array(*[F.sum(F.get("share_logs", F.lit(i))) for i in range(k)]).alias("share_logs"),
                *[F.sum(c).alias(c) for c in ("bound", "words", "docs", "converged")]).collect()  # a row per term
            shared.destroy()
            total = next(r for r in summed if r["term_id"] is None)
            if not total["docs"]:
                continue
            sums = np.zeros_like(model.weights)
            for r in summed:
                if r["term_id"] is not None:
                    sums[:, r["term_id"]] = r["sums"]
            rate, scale = (offset + step) ** -decay, batches.n_docs / total["docs"]
            model.weights = (1 - rate) * model.weights + rate * (model.eta + scale * sums)
            if learn_alpha:
                model.alpha = better_prior(model.alpha, np.array(total["share_logs"]) / total["docs"], total["docs"], rate)
            if learn_eta:
                log = log_share(model.weights)
                flat = np.full(batches.n_terms, model.eta)
                model.eta = float(better_prior(flat, np.full(batches.n_terms, log.mean()), k, rate)[0])
            for name in seen:
                seen[name] += total[name]
            step += 1
        bound = seen["bound"] + topics
        model.history.append({**seen, "pass": number, "bound": bound, "perplexity": math.exp(-seen["bound"] / max(seen["words"], 1))})
    return model


def fit_grid(batches: Batches, ks: Iterable[int], folder: str, at_once: int = 3, **settings) -> dict[int, Model]:
    """A model for each number of topics, ``at_once`` of them side by side over the same stored batches.

    Every fit runs in a scheduler pool of its own, so a FAIR scheduler shares the executors between them. A
    finished fit is kept below ``folder``; a second call reads it there and fits only what is missing.
    """
    spark = batches.vectors.sparkSession

    def one(k: int) -> Model:
        path = f"{folder.rstrip('/')}/k={k}"
        if path_exists(spark, f"{path}/_SUCCESS"):
            return Model.load(spark, path)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"k={k}")
        model = fit(batches, k, **settings)
        model.save(spark, path)
        return model

    ks = list(ks)
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return dict(zip(ks, pool.map(inheritable_thread_target(spark)(one), ks)))
