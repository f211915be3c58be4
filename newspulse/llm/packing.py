"""Packing documents into sequences by shortest-pack-first over the histogram of piece lengths.

Documents become pieces of at most a sequence; only the number of pieces of each length goes to the driver.
There, lengths are placed longest first, each into the shortest open pack, for all pieces of a length at once:
the plan is a list of packing patterns with counts. Pieces find their place in it by their rank among the
pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from newspulse.llm.common import SLICE, ref, small_batches
from newspulse.llm.token_ids import encoder_of
from newspulse.session import stage

SIZE = 2048
PIECE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("crc", T.LongType()),
])
PIECES = T.StructType([T.StructField("doc_tokens", T.LongType()), T.StructField("pieces", T.ArrayType(PIECE))])
PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def cut(ids: bytes, size: int, with_ids: bool) -> tuple[int, list[dict]]:
    """Whole sequences first, then the rest; four bytes an id."""
    step, out = 4 * size, []
    for at in range(0, len(ids), step):
        piece = ids[at:at + step]
        out.append({"start": at // 4, "length": len(piece) // 4, "ids": piece if with_ids else None, "crc": zlib.crc32(piece)})
    return len(ids) // 4, out


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, text: str = "text", key: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every whole text with ``end_id`` appended: key, doc_tokens, start, length, crc (and ids as bytes)."""
    kind = to_arrow_type(PIECES)
    small_batches()

    @F.arrow_udf(PIECES)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, end = encoder_of(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, max(len(batch), 1), SLICE):
                texts = [t.as_py() or "" for t in batch.slice(at, SLICE)]
                rows = [cut(ids + end, size, with_ids) for ids in encoder.encode_all(texts)]
                yield pa.array([{"doc_tokens": n, "pieces": p} for n, p in rows], kind)

    coded = docs.select(ref(key).alias("key"), encode(ref(text).cast("string")).alias("c"))
    out = coded.select("key", "c.doc_tokens", F.explode("c.pieces").alias("p"))
    return out.select("key", "doc_tokens", "p.start", "p.length", "p.crc", *(["p.ids"] if with_ids else []))


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go. Row i covers the pieces of ``length[i]`` from rank ``first[i]`` on:
    ``times[i]`` of them lie side by side from ``offset[i]`` in each sequence from ``sequence[i]`` on."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given their length and their rank from 0 among the pieces of it."""
        starts = self.length << 48 | self.first
        i = np.searchsorted(starts, length << 48 | rank, "right") - 1
        nth = rank - self.first[i]
        return self.sequence[i] + nth // self.times[i], self.offset[i] + nth % self.times[i] * length


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """Plan for ``histogram`` (pieces of each length up to ``size``); at most two patterns arise per length.

    Longest first; a piece goes to the shortest pack if it fits there, which is the one with most room, else it
    opens a pack. All pieces of a length that would meet packs of one pattern are placed in one step.
    """
    packs: list[tuple[int, int, int, tuple]] = []  # fill, tie, count, ((length, times), ...)
    tie, done = 0, []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and packs and packs[0][0] + length <= size:
            fill, _, count, items = heapq.heappop(packs)
            n = min(count, left)
            grown = (*items[:-1], (length, items[-1][1] + 1)) if items[-1][0] == length else (*items, (length, 1))
            tie += 1
            heapq.heappush(packs, (fill + length, tie, n, grown))
            if count > n:
                tie += 1
                heapq.heappush(packs, (fill, tie, count - n, items))
            left -= n
        many = size // length
        for times, n in ((many, left // many), (left % many, 1)) if left else ():
            if times and n:
                tie += 1
                heapq.heappush(packs, (times * length, tie, n, ((length, times),)))
    done = sorted(packs, key=lambda p: p[1])
    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for _, _, count, items in done:
        offset = 0
        for length, times in items:
            rows.append((length, ranks[length], times, sequence, offset))
            ranks[length] += count * times
            offset += length * times
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, n_sequences=sequence)


def _placing(plan: Plan) -> Callable[[Column, Column], Column]:
    kinds = to_arrow_type(PLACE)

    @F.arrow_udf(PLACE)
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = plan.place(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields=list(kinds))

    return place


def place(cuts: DataFrame, size: int = SIZE, buckets: int = 256) -> DataFrame:
    """``cuts`` (key, start, length, and more columns) with ``sequence_id`` and ``offset``.

    Ranks within a length come from ``buckets`` hash buckets of it, so a length that very many pieces share
    (whole sequences) is split. ``cuts`` is read twice and should be a stored table.
    """
    counts = cuts.groupBy("length").count().collect()  # at most ``size`` rows
    plan = shortest_pack_first({r["length"]: r["count"] for r in counts}, size)
    bucket = F.pmod(F.xxhash64("key", "start"), F.lit(buckets))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    dealt = cuts.withColumn("bucket", bucket)
    bases = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("key", "start", "crc", "doc_tokens")
    ranked = dealt.withColumn("nth", F.row_number().over(order)).join(bases, ["length", "bucket"])
    at = _placing(plan)(F.col("length"), F.col("base") + F.col("nth") - 1)
    return ranked.withColumn("at", at).select(
        *[c for c in cuts.columns], F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Pieces of all rows of ``docs`` with their place: key, start, length, crc, doc_tokens, sequence_id, offset.

    Null and empty texts are just the end id. A row longer than ``size`` is cut at multiples of it; each id lies
    in exactly one piece. Sequences have no gaps; which of several equal pieces goes where is arbitrary but the
    same in every run. Repeated rows and keys are packed like any others; null keys stay null; other columns are
    not read; no rows give no pieces. ``tokenizer`` is a path that every executor can read.
    """
    return place(stage(pieces(docs, tokenizer, end_id, size, text, key), "pieces"), size)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, pad_id: int = 0, size: int = SIZE, **names: str) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens and ids, padded to ``size`` unless a power of two."""
    placed = place(stage(pieces(docs, tokenizer, end_id, size, with_ids=True, **names), "pieces"), size)
    whole = placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    binary = F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))")
    digits = F.hex(binary)
    number = F.transform(
        F.sequence(F.lit(0), F.col("n_tokens").cast("int") - 1),
        lambda i: F.conv(F.concat(*[F.substring(digits, i * 8 + 2 * b + 1, F.lit(2)) for b in (3, 2, 1, 0)]), 16, 10).cast("int"))
    exact = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    pad = F.when(exact, F.lit(0)).otherwise(F.lit(size) - F.col("n_tokens")).cast("int")
    return whole.select("sequence_id", "n_tokens", F.concat(number, F.array_repeat(F.lit(pad_id), pad)).alias("ids"))
