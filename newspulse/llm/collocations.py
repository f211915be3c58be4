"""Phrase collocations by Rabin-Karp fingerprints.

Prefix polynomials over the words of a batch of texts give the fingerprint of every run of one to three words
without building its string. The shuffle aggregates fingerprints and counts. A run can only be frequent if the
two runs it is made of are, so each length is counted only where bit tables of fixed size, made of the frequent
fingerprints of the length before, let it pass; a bit set by chance costs work, never a result. Then the runs
whose fingerprint is frequent are grouped again in each batch, every group with a pointer to an occurrence; all
others are compared with the text there, and one that differs stands for itself. Only these groups become
strings, and the last counts are those of the strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.llm.common import ref, small_batches
from newspulse.operators.dedup import top_per_group
from newspulse.session import stage

MOST_WORDS = 3
BATCH = 2 << 20  # bytes of text hashed at a time; a longer text is hashed alone
TABLE_BITS = 27  # bits of a table of frequent fingerprints, as a power of two
PROBES = 3
# Odd multipliers of the polynomial and of the mixing steps.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

# What a byte is: 0 part of a word, 1 space between words, 2 end of a piece. A-Z become small letters.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a multiplier and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self):
        self.base, self.inverse = BASE, np.uint64(pow(int(BASE), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up, self.down = (
                np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


class Words:
    """The words of a batch of texts, lower-cased and joined by single spaces, and fingerprints of runs of them."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, powers: Powers):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # each text ends a piece
        kind = KIND[raw]
        word = kind == 0
        after = np.zeros(len(raw), bool)
        after[1:] = word[:-1]
        first, past = np.flatnonzero(word & ~after), np.flatnonzero(~word & after)
        keep = word | after  # the words, and one byte after each
        self.bytes = np.where(word, LOWER[raw], np.uint8(32))[keep]
        size = past - first
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        # Two words are in one piece if no end of a piece lies between them.
        breaks = np.concatenate(([0], np.cumsum(kind == 2)))
        self.piece = breaks[first]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.lang = langs[np.searchsorted(np.cumsum(sizes), first, "right")]
        weighted = (self.bytes.astype(np.uint64) + np.uint64(1)) * powers.upto(len(self.bytes) + 1)[0][:-1]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted)))
        self.down = powers.upto(len(self.bytes) + 1)[1]

    def code(self, names: list[str]) -> None:
        """Codes of the languages that are the same in every task."""
        self.code_of = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names], np.uint64)

    def runs(self, n: int) -> np.ndarray:
        """Numbers of the words that begin a run of ``n`` words of one piece."""
        last = len(self.piece) - n + 1
        if last <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1:])

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the runs of ``n`` words that begin at the words ``at``."""
        a, b = self.start[at], self.end[at + (n - 1)]
        value = (self.sums[b] - self.sums[a]) * self.down[a]
        return mixed(value + (b - a).astype(np.uint64) * MIX_A)

    def taken(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the runs, one after the other, and where each begins in them (and the last ends)."""
        size = self.end[at + (n - 1)] - self.start[at]
        edges = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[np.repeat(self.start[at] - edges[:-1], size) + np.arange(edges[-1])], edges

    def alike(self, at: np.ndarray, lead: np.ndarray, n: int) -> np.ndarray:
        """Whether each run has the same language and text as the run that leads it."""
        last = n - 1
        same = (self.lang[at] == self.lang[lead]) & (self.end[at + last] - self.start[at] == self.end[lead + last] - self.start[lead])
        for part in np.array_split(np.flatnonzero(same), len(same) // (1 << 16) + 1):
            (mine, edges), (theirs, _) = self.taken(at[part], n), self.taken(lead[part], n)
            if len(mine):
                same[part] = np.logical_and.reduceat(mine == theirs, edges[:-1])
        return same


def keyed(prints: np.ndarray, langs: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Fingerprints made to differ between languages and lengths, cut to ``bits`` bits."""
    out = mixed(prints ^ (langs * MIX_B) ^ np.uint64(n))
    return out if bits >= 64 else out & np.uint64((1 << bits) - 1)


def probes(keys: np.ndarray, table_bits: int) -> list[np.ndarray]:
    """Places of a key in a table of 2^``table_bits`` bits."""
    a, b = keys >> np.uint64(32), (mixed(keys) >> np.uint64(16)) | np.uint64(1)
    return [(a + np.uint64(i) * b) & np.uint64((1 << table_bits) - 1) for i in range(PROBES)]


def passes(table: np.ndarray, keys: np.ndarray, table_bits: int) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in probes(keys, table_bits):
        out &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)) != 0
    return out


def _batches(batches: Iterator[pa.RecordBatch], powers: Powers) -> Iterator[tuple[Words, list[str]]]:
    """Words of some texts at a time, and the languages by the numbers that the words have."""
    names: dict[str, int] = {}

    def words() -> tuple[Words, list[str]]:
        return Words(texts, np.array(langs, np.int64), powers), list(names)

    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer()
            if texts and size + data.size > BATCH:
                yield words()
                langs, texts, size = [], [], 0
            langs.append(names.setdefault(lang, len(names)))
            texts.append(data.to_pybytes())
            size += data.size
    if texts:
        yield words()


def _allowed(words: Words, n: int, tables: list[np.ndarray], bits: int, table_bits: int) -> np.ndarray:
    """Runs of ``n`` words that may be frequent, by the table of their own length or else of the runs one word shorter."""
    at, m = words.runs(n), min(n, len(tables))
    for shift in range(n - m + 1) if m else ():
        here = at + shift
        at = at[passes(tables[m - 1], keyed(words.prints(here, m), words.code_of[words.lang[here]], m, bits), table_bits)]
    return at


def _counts(docs: DataFrame, n: int, tables: list[Broadcast], bits: int, table_bits: int) -> DataFrame:
    """Counts of the fingerprints of the runs of ``n`` words whose parts may be frequent: (print, n)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, known = Powers(), [np.frombuffer(t.value, np.uint8) for t in tables]
        for words, langs in _batches(batches, powers):
            words.code(langs)
            at = _allowed(words, n, known, bits, table_bits)
            keys = keyed(words.prints(at, n), words.code_of[words.lang[at]], n, bits)
            keys.sort()
            first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
            sizes = np.diff(first, append=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(sizes.astype(np.int64))], ["print", "n"])

    return docs.mapInArrow(count, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))


def _table(frequent: DataFrame, table_bits: int) -> bytes:
    """Bit table of the fingerprints; rows of 32,768 bits are made where the fingerprints are."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate(probes(keys, table_bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["part", "bit"])

    parts = frequent.mapInArrow(places, "part long, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray((1 << table_bits) // 8)
    for r in parts.toLocalIterator():  # at most 2^table_bits bits
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


FOUND = "lang string, words int, phrase string, n long"


def _found(docs: DataFrame, tables: list[Broadcast], bits: int, table_bits: int) -> DataFrame:
    """Counts (lang, words, phrase, n) of the runs that pass the table of their own length; 0 words: all words."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, known = Powers(), [np.frombuffer(t.value, np.uint8) for t in tables]
        for words, langs in _batches(batches, powers):
            names = pa.array(langs, pa.string())
            words.code(langs)
            total = np.bincount(words.lang, minlength=len(langs))
            yield record(names, 0, pa.array([""] * len(langs), pa.string()), total)
            for n in range(1, len(known) + 1):
                at = _allowed(words, n, known, bits, table_bits)
                if not len(at):
                    continue
                keys = keyed(words.prints(at, n), words.code_of[words.lang[at]], n, bits)
                order = np.argsort(keys)
                keys, at = keys[order], at[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                lead = np.repeat(at[first], np.diff(first, append=len(at)))  # the occurrence that a group points to
                same = words.alike(at, lead, n)
                lead = np.concatenate((at[first], at[~same]))  # another text with the fingerprint of a group
                sizes = np.concatenate((np.add.reduceat(same.astype(np.int64), first), np.ones((~same).sum(), np.int64)))
                data, edges = words.taken(lead, n)
                phrase = pa.StringArray.from_buffers(len(lead), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data))
                yield record(names.take(pa.array(words.lang[lead])), n, phrase, sizes)

    def record(lang: pa.Array, n: int, phrase: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        columns = [lang, pa.array(np.full(len(lang), n, np.int32)), phrase, pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "n"])

    return docs.mapInArrow(find, FOUND).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def phrases(
    docs: DataFrame, least: int = 10, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang",
    bits: int = 64, table_bits: int = TABLE_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(every run of one to ``most_words`` words found ``least`` times or more, words per language).

    The first table is (lang, words, phrase, n), the second (lang, n). ``bits`` shortens the fingerprints and ``table_bits`` the bit tables (at least 15); both change the work only. See ``collocations`` for words,
    pieces and odd rows.
    """
    small_batches()
    rows = docs.select(F.coalesce(ref(lang).cast("string"), F.lit("und")).alias("lang"), ref(text).cast("string").alias("text"))
    rows, tables, context = rows.where("text <> ''"), [], docs.sparkSession.sparkContext
    for n in range(1, most_words + 1):
        frequent = _counts(rows, n, tables, bits, table_bits).where(F.col("n") >= least).select("print")
        tables.append(context.broadcast(_table(frequent, table_bits)))
    counts = stage(_found(rows, tables, bits, table_bits).where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
    return counts.where("words > 0"), counts.where("words = 0").select("lang", "n")


def _parts(phrases: DataFrame) -> DataFrame:
    """Each phrase of two words or more with every cut of it: (lang, words, phrase, a, k, head, rest)."""
    cut = phrases.where("words > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
    cut = cut.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    join = lambda part: F.array_join(part, " ")
    return cut.select(
        "lang", "words", "phrase", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("head"),
        join(F.slice("w", F.col("k") + 1, F.col("words"))).alias("rest"))


def score(a: str, left: str, right: str) -> F.Column:
    """floor(1,000,000 a a / (l r)), exact for counts of up to 15 digits."""
    return F.expr(f"(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0))) "
                  f"div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def collocations(
    docs: DataFrame, least: int = 10, top: int = 2000, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang",
    **sizes: int,
) -> DataFrame:
    """The phrases of two to ``most_words`` words that hold together best, for each language.

    A-Z count as a-z. Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and
    tabs; phrases lie within a piece and are counted with overlaps. Cutting a phrase found ``a`` >= ``least``
    times after k words gives the counts l and r of its parts and floor(10^6 a^2 / (l r)); the least value is its
    score, the smallest k among equals. A phrase goes if a longer one found at least half as often holds it.
    Returns lang, rank, phrase, a, l, r, n (all words of the language) and score, the first ``top`` of each language by score
    and a (largest first), then phrase (bytes). Null languages are ``und``; null and empty texts hold no words; repeated rows count
    each; other columns are not read; no rows, or no phrase often enough, give no rows. Memory in a task grows
    with the longest single text and the bit tables (2^``table_bits`` bits each), not with the corpus.
    """
    found, totals = phrases(docs, least, most_words, text, lang, **sizes)
    parts = _parts(found)
    count = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    cuts = parts.join(count("head", "l"), ["lang", "head"]).join(count("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", score("a", "l", "r"))
    best = F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("b")
    scored = cuts.groupBy("lang", "phrase").agg(best).select("lang", "phrase", "b.*")
    # Runs of words inside a longer phrase; one word shorter is enough only together with all shorter ones.
    inner = found.where("words > 2").withColumn("w", F.split("phrase", " ")).select(
        "lang", "words", F.col("n").alias("longer"), "w",
        F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "longer")
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.coalesce(F.col("longer"), F.lit(0)) * 100 >= F.col("a") * 50
    kept = scored.join(inner, ["lang", "phrase"], "left").where(~held)
    ranked = top_per_group(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, rank="rank")
    long = lambda c: F.col(c).cast("long").alias(c)
    return ranked.join(totals, "lang").select("lang", long("rank"), "phrase", *map(long, ("a", "l", "r", "n", "score")))
