"""Document fingerprints by locally consistent parsing.

A text is cut into phrases where its own bytes say so: runs of equal symbols become one symbol, deterministic
coin tossing turns each symbol and its left neighbour into a label of a few values, and a phrase starts at each
local maximum of the labels. A phrase is named by what it holds, and the names are parsed again, level by level.
Inside equal substrings the phrases and names are the same wherever the substrings stand. The fingerprint is
the least names of the phrases of two levels, about 15 and 36 bytes long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newspulse.llm.common import ref, small_batches
from newspulse.session import stage

LEVELS = (3, 4)
LEAST = 64  # names in a fingerprint
BATCH = 1 << 20  # bytes parsed at a time; a longer text is parsed alone
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
RUN = np.uint64(0xA0761D6478BD642F)


def _toss(values: int) -> np.ndarray:
    """Label of a symbol after another, for symbols below ``values``: twice the lowest differing bit, plus its value."""
    a, b = np.meshgrid(np.arange(values), np.arange(values), indexing="ij")
    apart = a ^ b
    low = np.where(apart > 0, np.bitwise_count((apart & -apart) - 1).astype(np.int64), 0)
    return np.where(apart > 0, 2 * low + (b >> low & 1), b & 1).astype(np.uint8).ravel()


BYTES, TOSS128, TOSS16, TOSS8 = _toss(256), _toss(128), _toss(16), _toss(8)
POWERS = np.cumprod(np.full(1 << 16, BASE, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


BYTE_NAMES = mixed(np.arange(1, 257, dtype=np.uint64))


def _runs(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each run of equal symbols in one document, and its length."""
    new = np.ones(len(symbols), bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(symbols)), new


def _labels(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below six of symbols of which no two neighbours are equal; ``head`` marks the first of each document."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[head] = ~symbols[head]
    if symbols.dtype == np.uint8:
        label = BYTES[before.astype(np.uint16) << 8 | symbols]
    else:
        apart = before ^ symbols
        low = apart & (~apart + np.uint64(1))
        label = (np.bitwise_count(low - np.uint64(1)) << 1) | ((symbols & low) != 0)
        label = label.astype(np.uint8)

    def again(label: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
        out = np.empty_like(label)
        out[1:] = table[label[:-1].astype(np.uint16) << bits | label[1:]]
        out[head] = label[head] & 1
        return out

    if symbols.dtype != np.uint8:
        label = again(label, TOSS128, 7)
    return again(again(label, TOSS16, 4), TOSS8, 3)


def parse(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of all documents, and the document of each."""
    first, many, _ = _runs(symbols, doc)
    single, doc = symbols[first], doc[first]
    names = BYTE_NAMES[single] if symbols.dtype == np.uint8 else mixed(single)
    repeated = many > 1
    names[repeated] = mixed(names[repeated] ^ (many[repeated].astype(np.uint64) * RUN))
    # Labels look at the bare symbols: neighbours differ, and a longer run does not move the cuts after it.
    head = np.ones(len(single), bool)
    head[1:] = doc[1:] != doc[:-1]
    label = _labels(single, head)
    starts = head.copy()
    if len(single) > 2:
        # Neither the symbol after a document's first nor its last one starts a phrase.
        inner = ~(head[1:-1] | head[:-2] | head[2:])
        starts[1:-1] |= inner & (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    at = np.flatnonzero(starts)
    size = np.diff(at, append=len(single))
    within = np.arange(len(single)) - np.repeat(at, size)
    weighted = names * POWERS[within & 0xFFFF] + within.astype(np.uint64)
    return (mixed(np.add.reduceat(weighted, at)) if len(at) else names[:0]), doc[at]


def least_names(texts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """Sorted least 32-bit names of each text's phrases; of the whole text if it is too short for any."""
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    found = []
    for level in range(1, max(LEVELS) + 1):
        symbols, doc = parse(symbols, doc)
        if level in LEVELS:
            found.append((doc.astype(np.uint64) << np.uint64(32)) | (symbols >> np.uint64(32)))
    keys = np.unique(np.concatenate(found))
    edges = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return [(keys[a:min(b, a + least)] & np.uint64(0xFFFFFFFF)).astype(np.uint32) for a, b in zip(edges, edges[1:])]


def likeness(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> float:
    """Estimated share of common phrases: of the least names of both, those that both have. Two empty ones are alike."""
    both = np.union1d(a, b)[:least]
    return float(np.isin(both, np.intersect1d(a, b)).mean()) if len(both) else 1.0


def to_bytes(names: np.ndarray) -> bytes:
    return names.astype(">u4").tobytes()


def to_text(names: np.ndarray) -> str:
    return to_bytes(names).hex()


def from_bytes(fingerprint: bytes) -> np.ndarray:
    return np.frombuffer(fingerprint, ">u4").astype(np.uint32)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Names of many texts, parsed together in batches."""
    out, batch, size = [], [], 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass")
        if batch and size + len(data) > BATCH:
            out += least_names(batch)
            batch, size = [], 0
        batch.append(data)
        size += len(data)
    return out + (least_names(batch) if batch else [])


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROWS = (
    "key long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, part int, head string, tail string"
)
NAMES = [c.split()[0] for c in ROWS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)


def _compared(keys: list, texts: list[str], following: list[str], own: list, after: list, part: int) -> list[tuple]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    prints = fingerprints(changed)
    return [
        (k, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest(), to_bytes(o), to_bytes(p),
         likeness(o, p), likeness(o, a), part, None, None)
        for k, t, c, o, p, a in zip(keys, texts, changed, own, prints, after)
    ]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task in order, each compared with the next; the first row brings its text as ``head`` and the
    last, which has its next in another task, its own as ``tail``."""
    part, waiting, fresh = TaskContext.get().partitionId(), None, True
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            keys, texts = some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]
            own = fingerprints(texts)
            if waiting is not None:
                keys, texts, own = [waiting[0], *keys], [waiting[1], *texts], [waiting[2], *own]
            rows = _compared(keys[:-1], texts[:-1], texts[1:], own[:-1], own[1:], part)
            if fresh:
                yield _record([(None, None, None, to_bytes(own[0]), None, None, None, part, texts[0], None)])
                fresh = False
            if rows:
                yield _record(rows)
            waiting = (keys[-1], texts[-1], own[-1])
    if waiting is not None:
        yield _record([(waiting[0], None, None, to_bytes(waiting[2]), None, None, None, part, None, waiting[1])])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            key, part, fingerprint, tail, head, other = (c[i].as_py() for c in batch.columns)
            yield _record(_compared([key], [tail], [head], [from_bytes(fingerprint)], [from_bytes(other)], part))


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each whole text and of its edited form, and their likeness, a row for each row of ``docs``.

    The edited form ends with the beginning of the next document in descending order of ``key`` (an integer, null
    last; rows with one key in the order of a hash of their text), the first following the last. Returns ``key``,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Null texts are empty; the
    fingerprint of an empty text is empty. A single row follows itself. Other columns are not read, and no rows
    give no rows. Texts are shuffled once, into ranges of the order; only the first and the last row of a range
    meet their neighbour in a join.
    """
    small_batches()
    rows = docs.select(ref(key).cast("long").alias("key"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("key").desc_nulls_last(), F.col("tie").desc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    swept = stage(ranged.mapInArrow(_sweep, ROWS), "fingerprints")
    heads = swept.where("head is not null").select("part", "head", F.col("fingerprint").alias("other"))
    tails = swept.where("tail is not null").select("key", "part", "fingerprint", "tail")
    # One row per task that had rows; the window runs over these.
    turn = Window.orderBy("part")
    parts = heads.select("part").withColumn("next", F.lead("part").over(turn))
    first = F.min("part").over(Window.partitionBy())
    parts = parts.select("part", F.coalesce("next", first).alias("next"))
    pairs = tails.join(parts, "part").join(heads.withColumnRenamed("part", "next"), "next")
    joined = pairs.select("key", "part", "fingerprint", "tail", "head", "other").mapInArrow(_finish, ROWS)
    # Stored as bytes, half the size of the text.
    written = lambda c: F.lower(F.hex(c)).alias(c)
    return swept.where("head is null and tail is null").unionByName(joined).select(
        F.col("key").alias(key), "n_chars", *map(written, NAMES[2:5]), *NAMES[5:7])
