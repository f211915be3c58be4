"""Quality classifier: a byte-level convolutional network in numpy over whole documents.

Bytes are embedded, two more channels say whether a byte belongs to something that stands just before or
elsewhere in the text, and learned filters slide over overlapping chunks that cover the whole document. Each
filter keeps its maximum; a logistic unit combines the maxima into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse.llm.common import ref, text_udf
from newspulse.llm.linear import held_out, may_learn, sample_by

WIDTH, STRIDE = 16, 8
EMBED, FILTERS = 6, 32
CHANNELS = EMBED + 2
LAGS = 24  # how far back a trigram counts as standing just before
FAR = 32  # bytes that must stand elsewhere in the text to count as repeated
SAMPLE = 1600  # labelled texts to learn from, half of each label
PASSES = 8
BLOCK = 1 << 18
GOOD_FROM = 0.7
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeats(data: np.ndarray) -> np.ndarray:
    """Two flags a byte: its trigram ends within ``LAGS`` bytes before; its ``FAR`` bytes stand elsewhere too."""
    out = np.zeros((len(data), 2), np.float32)
    if len(data) > 3:
        wide = data.astype(np.uint32)
        tri = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
        near = np.zeros(len(tri), bool)
        for lag in range(1, min(LAGS, len(tri) - 1) + 1):
            near[lag:] |= tri[lag:] == tri[:-lag]
        out[2:, 0] = near
    if len(data) > FAR:
        name, span = data.astype(np.uint64) + np.uint64(1), 1
        while span < FAR:
            name = name[:-span] * MIX + (name[span:] ^ (name[span:] >> np.uint64(29)))
            span *= 2
        order = np.argsort(name)
        same = name[order[1:]] == name[order[:-1]]
        hit = np.zeros(len(data) + 1, np.int32)
        twice = np.zeros(len(name), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        where = np.flatnonzero(twice)
        hit[where] += 1
        hit[where + FAR] -= 1
        out[:, 1] = np.cumsum(hit)[:-1] > 0
    return out


def prepare(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and flags of a text, filled up with zero bytes to a whole number of strides and one chunk at least."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    size = max(WIDTH, -(-max(len(data) - WIDTH, 0) // STRIDE) * STRIDE + WIDTH)
    padded = np.zeros(size, np.uint8)
    padded[:len(data)] = data
    flags = np.zeros((size, 2), np.float32)
    flags[:len(data)] = repeats(data)
    return padded, flags


@dataclass
class Net:
    embed: np.ndarray  # bytes x EMBED
    filters: np.ndarray  # WIDTH * CHANNELS x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float

    @classmethod
    def start(cls, seed: int) -> Net:
        draw = np.random.default_rng(seed)
        return cls(
            draw.normal(0, 0.3, (256, EMBED)).astype(np.float32),
            draw.normal(0, (2 / (WIDTH * CHANNELS)) ** 0.5, (WIDTH * CHANNELS, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32), draw.normal(0, 0.2, FILTERS).astype(np.float32), 0.0)

    def chunks(self, data: np.ndarray, flags: np.ndarray, first: int, last: int) -> np.ndarray:
        """Inputs of chunks ``first`` to ``last``, a row each."""
        a, b = first * STRIDE, (last - 1) * STRIDE + WIDTH
        x = np.hstack([self.embed[data[a:b]], flags[a:b]])
        step = x.strides[0]
        view = np.lib.stride_tricks.as_strided(x, (last - first, WIDTH, CHANNELS), (STRIDE * step, step, x.strides[1]))
        return view.reshape(last - first, WIDTH * CHANNELS)

    def pool(self, data: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter over all chunks, and the chunk that has it."""
        n = (len(data) - WIDTH) // STRIDE + 1
        best, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        step = BLOCK // STRIDE
        for first in range(0, n, step):
            got = self.chunks(data, flags, first, min(first + step, n)) @ self.filters
            at = got.argmax(0)
            top = got[at, np.arange(FILTERS)]
            where = np.where(top > best, at + first, where)
            best = np.maximum(best, top)
        return np.maximum(best + self.bias, 0), where

    def score(self, text: str | None) -> float:
        pooled, _ = self.pool(*prepare(text))
        return float(1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30))))


def train(texts: list[str], labels: list[int], passes: int = PASSES, rate: float = 0.01, batch: int = 16, seed: int = 3) -> Net:
    """Fit by Adam on the logistic loss; a filter learns from the chunk where it is greatest in each document."""
    net = Net.start(seed)
    ready = [prepare(t) for t in texts]
    params = ["embed", "filters", "bias", "out", "shift"]
    m = {p: np.zeros_like(getattr(net, p), dtype=np.float64) for p in params}
    v = {p: np.zeros_like(getattr(net, p), dtype=np.float64) for p in params}
    draw, t = np.random.default_rng(seed), 0
    total = passes * -(-len(ready) // batch)
    for _ in range(passes):
        order = draw.permutation(len(ready))
        for start in range(0, len(order), batch):
            grad = {p: np.zeros_like(getattr(net, p), dtype=np.float64) for p in params}
            some = order[start:start + batch]
            for i in some:
                data, flags = ready[i]
                pooled, where = net.pool(data, flags)
                p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -30, 30)))
                d = (p - labels[i]) / len(some)
                grad["out"] += d * pooled
                grad["shift"] += d
                live = d * net.out * (pooled > 0)
                grad["bias"] += live
                at = where[:, None] * STRIDE + np.arange(WIDTH)
                x = np.concatenate([net.embed[data[at]], flags[at]], axis=2).reshape(FILTERS, -1)
                grad["filters"] += (live[:, None] * x).T
                back = (live[:, None] * net.filters.T).reshape(FILTERS * WIDTH, CHANNELS)[:, :EMBED]
                np.add.at(grad["embed"], data[at].ravel(), back)
            t += 1
            step = rate * min(1.0, 2 * (1 - t / (total + 1)))
            for p in params:
                m[p] = 0.9 * m[p] + 0.1 * grad[p]
                v[p] = 0.999 * v[p] + 0.001 * grad[p] ** 2
                change = step * (m[p] / (1 - 0.9**t)) / (np.sqrt(v[p] / (1 - 0.999**t)) + 1e-8)
                now = getattr(net, p) - change
                setattr(net, p, float(now) if p == "shift" else now.astype(np.float32))
    return net


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Net | None:
    """Fit to about ``sample`` labelled whole texts that are not held out; None if there are none.

    Keys and labels are chosen first, from the narrow table of labels; the join then keeps their texts alone. A
    key with several labels has the least of them.
    """
    known = labels.select(ref(key).alias("key"), ref(label).alias("label")).where(may_learn(F.col("key")) & F.col("label").isin(0, 1))
    chosen = sample_by(known.groupBy("key").agg(F.min("label").alias("label")), "label", "key", sample)
    texts = docs.select(ref(key).alias("key"), ref(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "key").collect()  # about ``sample`` rows, whatever the size of the tables
    rows.sort(key=lambda r: (r["key"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["label"] for r in rows]) if rows else None


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, net: Net | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, held_out, score and predicted label of each row of ``docs``, from its whole text alone.

    Null texts count as empty and get the score of an empty text; without a network every score is 0.5. Equal
    texts get equal scores, repeated rows stay repeated, an empty table gives an empty result.
    """
    def make():
        return lambda body: (0.5 if net is None else net.score(body),)

    rows = docs.select(
        ref(key).alias(key), held_out(ref(key)).alias("held_out"), text_udf(make, SCORE)(ref(text).cast("string"))["score"].alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0))
