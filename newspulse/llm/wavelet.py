"""Token ids of a corpus as wavelet-matrix shards: one compressed file per shard, with rank and select.

Documents are encoded in ascending key order, cut into shards of bounded size, and each shard is one row (and
one file) of a Parquet folder: its payload holds the keys and lengths of its documents, the alphabet of the
token ids that occur, and one bit plane per bit of their ranks. Parquet compresses and commits the files, so a
lost executor leaves no half-written shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newspulse.llm.common import SLICE, ref, small_batches
from newspulse.llm.token_ids import encoder_of

MAGIC = b"WVM1"
HEAD = struct.Struct("<4sQIIB")
SUPER = 512  # bits between two stored ranks
SHARD_TOKENS = 2_000_000

SHARDS = "part int, seq int, n_docs long, n_tokens long, payload binary"
RECORDS = "part int, seq int, key long, start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Bit planes of a sequence of codes, most significant first; in each, zeros go before ones in the next."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, codes: np.ndarray, n_planes: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        now = codes
        for p in range(n_planes - 1, -1, -1):
            bit = (now & now.dtype.type(1 << p)) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            ones = np.zeros(-(-len(bit) // SUPER) * (SUPER // 8), np.uint8)
            ones[:len(packed)] = np.bitwise_count(packed)
            ones = ones.reshape(-1, SUPER // 8).sum(1, dtype=np.int64)
            ranks.append(np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))
            low = np.compress(~bit, now)
            zeros.append(len(low))
            now = np.concatenate((low, np.compress(bit, now)))
        return cls(len(codes), planes, zeros, ranks)

    def decode(self) -> np.ndarray:
        """All codes in order."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for p, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~bit)] = now[:z]
            above[np.flatnonzero(bit)] = now[z:] | kind(1 << p)
            now = above
        return now

    def _bit(self, level: int, i: int) -> int:
        return self.planes[level][i >> 3] >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        block = i // SUPER
        at = block * SUPER
        bits = np.unpackbits(self.planes[level][at >> 3:(i + 7) >> 3])[:i - at]
        return int(self.ranks[level][block]) + int(bits.sum())

    def access(self, i: int) -> int:
        """The code at place ``i``."""
        code = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = code << 1 | int(bit)
        return code

    def _interval(self, code: int, end: int) -> tuple[int, int, list[int]]:
        lo, hi, starts = 0, end, []
        for level in range(len(self.planes)):
            starts.append(lo)
            a, b = self._ones(level, lo), self._ones(level, hi)
            if code >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi, starts

    def rank(self, code: int, end: int) -> int:
        """Occurrences of ``code`` before place ``end``."""
        lo, hi, _ = self._interval(code, end)
        return hi - lo

    def select(self, code: int, k: int) -> int:
        """Place of occurrence ``k`` of ``code``, counted from 0; there must be more than ``k``."""
        lo, hi, _ = self._interval(code, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            want = i - self.zeros[level] + 1 if bit else i + 1
            i = self._find(level, bit, want)
        return i

    def _find(self, level: int, bit: int, want: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        counts = ranks if bit else np.minimum(np.arange(len(ranks)) * SUPER, self.n) - ranks
        block = int(np.searchsorted(counts, want, "left")) - 1
        at = block * SUPER
        bits = np.unpackbits(self.planes[level][at >> 3:(min(at + SUPER, self.n) + 7) >> 3])
        here = np.flatnonzero(bits == bit)
        return at + int(here[want - int(counts[block]) - 1])


class Shard:
    """Documents and their token ids, stored or read back; ids are looked up through the shard's alphabet."""

    def __init__(self, keys: list[int | None], lengths: np.ndarray, alphabet: np.ndarray, matrix: WaveletMatrix):
        self.keys, self.lengths, self.alphabet, self.matrix = keys, lengths, alphabet, matrix

    @classmethod
    def of(cls, keys: list[int | None], lengths: list[int], ids: np.ndarray) -> Shard:
        seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        planes = max(1, int(len(alphabet) - 1).bit_length())
        rank = (np.cumsum(seen) - 1).astype(np.uint16 if planes <= 16 else np.uint32)
        return cls(keys, np.array(lengths, np.uint32), alphabet, WaveletMatrix.build(rank[ids], planes))

    def to_bytes(self) -> bytes:
        m = self.matrix
        null = np.array([k is None for k in self.keys], bool)
        keys = np.array([k or 0 for k in self.keys], np.int64)
        head = HEAD.pack(MAGIC, m.n, len(self.keys), len(self.alphabet), len(m.planes))
        body = [keys, null, self.lengths, self.alphabet, np.array(m.zeros, np.uint64), *m.ranks, *m.planes]
        return head + b"".join(x.tobytes() for x in body)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, n, n_docs, n_ids, n_planes = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = HEAD.size

        def take(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        keys, null = take(np.int64, n_docs), take(np.bool_, n_docs)
        lengths, alphabet, zeros = take(np.uint32, n_docs), take(np.uint32, n_ids), take(np.uint64, n_planes)
        ranks = [take(np.uint32, -(-n // SUPER) + 1) for _ in range(n_planes)]
        planes = [take(np.uint8, (n + 7) // 8) for _ in range(n_planes)]
        named = [None if x else int(k) for k, x in zip(keys, null)]
        return cls(named, lengths, alphabet, WaveletMatrix(n, planes, [int(z) for z in zeros], ranks))

    def ids(self) -> np.ndarray:
        return self.alphabet[self.matrix.decode()]

    def _code(self, token: int) -> int | None:
        code = int(np.searchsorted(self.alphabet, token))
        return code if code < len(self.alphabet) and self.alphabet[code] == token else None

    def token(self, i: int) -> int:
        """Token id at place ``i`` of the shard."""
        return int(self.alphabet[self.matrix.access(i)])

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token id before place ``end`` (in the whole shard)."""
        code = self._code(token)
        return 0 if code is None else self.matrix.rank(code, self.matrix.n if end is None else end)

    def find(self, token: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of a token id."""
        code = self._code(token)
        if code is None:
            raise IndexError(k)
        return self.matrix.select(code, k)


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode every whole text, append ``end_id`` and write shard files to the new folder ``path``.

    Documents are in ascending order of ``key`` (an integer; null first), those with one key in the order of a
    hash of their text, so a key with very many rows is still split. Null and empty texts are just the end id.
    A shard ends with the document that brings it to ``shard_tokens`` or with its task. ``tokenizer`` is a path
    that every executor can read. No documents give no file with rows.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        keys, lengths, parts, n = [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[part], [seq], [len(keys)], [n], [Shard.of(keys, lengths, ids).to_bytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds)], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                texts = [t.as_py() or "" for t in some.column(1)]
                for k, ids in zip(some.column(0), encoder.encode_all(texts)):
                    keys.append(k.as_py())
                    lengths.append(len(ids) // 4 + 1)
                    parts.append(ids + end)
                    n += lengths[-1]
                    if n >= shard_tokens:
                        yield shard()
                        seq += 1
                        keys, lengths, parts, n = [], [], [], 0
        if keys:
            yield shard()

    small_batches()
    rows = docs.select(ref(key).cast("long").alias("key"), ref(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    shards = rows.mapInArrow(encode, SHARDS)
    shards.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Place of each shard's first token in the corpus: (part, seq, before).

    The two sums run over shards and over the tasks that wrote them, never over documents.
    """
    shards = spark.read.schema(SHARDS).parquet(path).select("part", "seq", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = shards.withColumn("local", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return local.join(parts, "part").select("part", "seq", (F.col("base") + F.col("local")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document read back from the shard files: key, start in the corpus, n_tokens, crc32 of its ids."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part"), batch.column("seq"), batch.column("payload")):
                shard = Shard.from_bytes(data.as_py())
                ids = shard.ids().astype("<u4", copy=False)
                ends = np.cumsum(shard.lengths.astype(np.int64))
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()),
                    pa.array(shard.keys, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64()),
                ], ["part", "seq", "key", "start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SHARDS).parquet(path).select("part", "seq", "payload").mapInArrow(decode, RECORDS)
    return rows.join(shard_starts(spark, path), ["part", "seq"]).select(
        "key", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
