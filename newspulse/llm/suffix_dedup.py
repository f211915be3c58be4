"""Removal of long byte strings that occur more than once, by suffix arrays.

The windows of ``length`` bytes of every text are dealt by their least inner gram, so that equal windows meet
wherever they stand: neighbouring windows with the same least gram form a piece, and pieces with equal grams form
a group. Equal pieces are merged before they are shuffled. Groups whose pieces differ hold the ends of shared
passages; a suffix array of each group brings equal windows next to each other.

The suffix array is built by linear grouping: suffixes are grouped by their first byte, the groups are processed
in descending order, and each processed group splits the groups of the suffixes that its previous-smaller
pointers lead to, until suffixes with one Lyndon prefix form one group. A second pass over the array itself puts
the suffixes of each group in order. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.llm.common import ref, small_batches
from newspulse.session import stage

LENGTH = 400
BATCH = 2 << 20  # bytes whose windows are found at a time
GROUP = 256  # different pieces of a group that one suffix array holds; larger groups are dealt again
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---- suffix arrays ------------------------------------------------------------------------------

def lyndon_groups(text: bytes) -> tuple[list[int], list[int]]:
    """Group and previous-smaller pointer of each suffix of ``text`` with an end mark below all bytes.

    Groups are numbered by their place in the suffix array; the suffixes of one group have the same Lyndon
    prefix. The pointer of suffix i is the last suffix before i in a smaller group, or -1.
    """
    n = len(text) + 1
    members: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        members.setdefault(c, []).append(i)
    group, prev, begin, end = [0] * n, [-1] * n, {1: 0}, {0: 1}
    at, by_place = 1, {0: [n - 1]}
    for c in sorted(members):
        for i in members[c]:
            group[i] = at
        by_place[at] = members[c]
        end[at] = at + len(members[c])
        begin[end[at]] = at
        at = end[at]
    top = n
    while top > 0:
        g = begin[top]
        here = by_place.pop(g)
        if len(here) > top - g:  # some have been moved on since
            here = [i for i in here if group[i] == g]
        if len(here) == 1:
            j = here[0] - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[here[0]] = j
            times = {1: [j]} if j >= 0 else {}
        else:
            here.sort()
            count: dict[int, int] = {}
            for i in here:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    count[j] = count.get(j, 0) + 1
            times = {}
            for j, k in count.items():
                times.setdefault(k, []).append(j)
        for k in sorted(times, reverse=True):
            apart: dict[int, list[int]] = {}
            for j in times[k]:
                apart.setdefault(group[j], []).append(j)
            for h, moved in apart.items():
                past = end[h]
                new = past - len(moved)
                if new > h:  # else all that is left of the group moves, which changes nothing
                    for j in moved:
                        group[j] = new
                    by_place[new] = moved
                    begin[past], end[new], end[h], begin[new] = new, past, new, h
        top = g
    return group, prev


def suffix_array(text: bytes) -> list[int]:
    """Starts of all suffixes of ``text`` in ascending order, the empty one first."""
    group, prev = lyndon_groups(text)
    n = len(group)
    out, front, placed = [n - 1] * n, list(range(n)), bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            place = front[g]
            front[g] = place + 1
            out[place] = j
            placed[j] = 1
            j = prev[j]
    return out


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, whether the ``length`` bytes at each place occur at another place of these pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = b"".join(pieces)
    data = np.frombuffer(text, np.uint8)
    starts = np.cumsum(sizes) - sizes
    valid = np.zeros(len(data) + 1, bool)
    for a, n in zip(starts, sizes):
        valid[a:a + max(0, n - length + 1)] = True
    order = np.array(suffix_array(text), np.int64)
    # Windows that run over the end of a piece do not count, and equal windows stay neighbours without them.
    order = order[valid[order]]
    found = np.zeros(len(data) + 1, bool)
    if len(order) > 1:
        windows = np.lib.stride_tricks.sliding_window_view(data, length)
        for at in range(0, len(order) - 1, 4096):
            a, b = order[at:at + 4096], order[at + 1:at + 4097]
            a = a[:len(b)]
            same = (windows[a] == windows[b]).all(1)
            found[a[same]] = True
            found[b[same]] = True
    return [found[a:a + max(0, n - length + 1)] for a, n in zip(starts, sizes)]


# ---- windows and their pieces -------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _geometric(base: int, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))))


def widths(length: int) -> list[int]:
    """Grams of a window at the first and all further levels; at the last one a gram is a whole window."""
    width = 1
    while width * 2 <= length * 0.64:
        width *= 2
    out = [width]
    while out[-1] > 1:
        out.append(max(1, out[-1] // 4))
    return out


class Windows:
    """Finds the pieces of texts: runs of windows with one least gram, with that gram's hash.

    Windows hold ``width`` grams, a power of two.
    """

    def __init__(self, length: int, width: int):
        self.length, self.width, self.gram = length, width, length - width + 1
        self.up = self.down = np.ones(1, np.uint64)

    def pieces(self, data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and hash of each piece; ``valid`` says which places begin a window."""
        if len(self.up) < len(data) + 1:
            self.up = _geometric(int(BASE), len(data) + 1)
            self.down = _geometric(pow(int(BASE), -1, 1 << 64), len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=sums[1:])
        grams = mixed((sums[self.gram:] - sums[:-self.gram]) * self.down[:len(data) + 1 - self.gram])
        least, step = grams, 1
        while step < self.width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        valid = valid[:len(least)]
        new = valid.copy()
        # The first of the least grams of a window stays that of the next one unless it begins the window.
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (grams[:len(least) - 1] == least[:-1])
        first = np.flatnonzero(new)
        before = np.cumsum(valid)[first] - 1
        return first, np.diff(before, append=int(valid.sum())), least[first]


def _segments(rows: list, texts: list[bytes], length: int) -> Iterator[tuple[list[tuple], bytes]]:
    """Texts joined to about ``BATCH`` bytes, longer ones in parts; each part (row, offset, place, windows)."""
    parts, joined, size = [], [], 0
    for row, text in zip(rows, texts):
        for a in range(0, len(text) - length + 1, BATCH):
            data = text[a:a + BATCH + length - 1]
            parts.append((row, a, size, len(data) - length + 1))
            joined.append(data)
            size += len(data)
            if size >= BATCH:
                yield parts, b"".join(joined)
                parts, joined, size = [], [], 0
    if parts:
        yield parts, b"".join(joined)


PIECES = "key long, h1 long, h2 long, copies long, row long, start long, n long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
NAME = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def _record(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _pieces(texts: DataFrame, length: int, width: int) -> DataFrame:
    """Pieces of all texts. Equal pieces of a batch are one row with their number; the rows with 0 copies say which
    windows of a text (joined where they meet) are known to be repeated by that."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length, width)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
            for parts, joined in _segments(rows, texts, length):
                yield from described(windows, parts, joined)

    def described(windows: Windows, parts: list, joined: bytes) -> Iterator[pa.RecordBatch]:
        data, view = np.frombuffer(joined, np.uint8), memoryview(joined)
        valid = np.zeros(len(data), bool)
        for _, _, place, many in parts:
            valid[place:place + many] = True
        first, many, keys = windows.pieces(data, valid)
        text = [hashlib.blake2b(view[a:a + m + length - 1], digest_size=16).digest() for a, m in zip(first.tolist(), many.tolist())]
        names = np.frombuffer(b"".join(text), NAME)
        part = np.searchsorted(np.array([p[2] for p in parts]), first, "right") - 1
        row, copies = (np.array([p[0][i] for p in parts], np.int64)[part] for i in (0, 1))
        start = first - np.array([p[2] - p[1] for p in parts], np.int64)[part]
        order = np.lexsort((names["h2"], names["h1"]))
        new = np.ones(len(order), bool)
        new[1:] = (names["h1"][order][1:] != names["h1"][order][:-1]) | (names["h2"][order][1:] != names["h2"][order][:-1])
        lead = np.flatnonzero(new)
        total, one = np.add.reduceat(copies[order], lead), order[lead]
        yield _record(NAMES, [
            keys[one].view(np.int64), names["h1"][one], names["h2"][one], total, row[one], start[one], many[one]])
        known = np.sort(order[np.repeat(total > 1, np.diff(lead, append=len(order)))])
        if len(known):
            r, s, m = row[known], start[known], many[known]
            head = np.ones(len(known), bool)
            head[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + m[:-1])
            at = np.flatnonzero(head)
            nothing = np.zeros(len(at), np.int64)
            yield _record(NAMES, [nothing, nothing, nothing, nothing, r[at], s[at], np.add.reduceat(m, at)])

    return texts.select("row", "copies", "text").mapInArrow(find, PIECES)


CUT = "key long, h1 long, h2 long, copies long, large boolean, n long, text binary"


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted pieces."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [(c, pa.int64()) for c in ("key", "h1", "h2", "copies")]
        schema = pa.schema([*fields, ("large", pa.bool_()), ("n", pa.int64()), ("text", pa.binary())])
        for batch in batches:
            for text, wants in zip(batch.column(0), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                out = [{**w, "text": data[w["start"]:w["start"] + w["n"] + length - 1]} for w in wants.as_py()]
                for at in range(0, len(out), 1024):
                    yield pa.RecordBatch.from_pylist(out[at:at + 1024], schema)

    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "h1", "h2", "copies", "large", "start", "n")).alias("wants"))
    return texts.join(lists, "row").select("text", "wants").mapInArrow(cut, CUT)


RANGES = "h1 long, h2 long, ranges array<struct<start:long,n:long>>"


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    """Starts and lengths of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    start = np.flatnonzero(edge == 1)
    return [{"start": a, "n": b - a} for a, b in zip(start.tolist(), np.flatnonzero(edge == -1).tolist())]


def _by_suffixes(pieces: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows of the pieces, a suffix array for each group; pieces with copies are whole ranges."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if group and r["key"] != key:
                    yield ranges(group)
                    group = []
                key = r["key"]
                group.append(r)
        if group:
            yield ranges(group)

    def ranges(group: list[dict]) -> pa.RecordBatch:
        rows = []
        for piece, flags in zip(group, repeated_windows([p["text"] for p in group], length)):
            found = [{"start": 0, "n": piece["n"]}] if piece["copies"] > 1 else _runs(flags)
            rows.append({"h1": piece["h1"], "h2": piece["h2"], "ranges": found})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ranges", kind)])
        return pa.RecordBatch.from_pylist([r for r in rows if r["ranges"]], schema)

    dealt = pieces.select("key", "h1", "h2", "copies", "n", "text").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, RANGES)


def repeated_ranges(texts: DataFrame, length: int = LENGTH, group: int = GROUP, level: int = 0) -> DataFrame:
    """Ranges of repeated windows: (row, start, ranges), the places of ``ranges`` counted from ``start`` on.

    ``texts`` is a stored table of (row, copies, text), in which ``copies`` tells how often a text occurs; the
    ``length`` bytes at each place in a range also start elsewhere. Ranges may overlap and come in any order.
    Groups of more than ``group`` different pieces are dealt again by longer grams, the last of which are whole
    windows, so that no task holds a larger group.
    """
    width = widths(length)[level:]
    pieces = stage(_pieces(texts, length, width[0]), "pieces")
    known, pieces = pieces.where("copies = 0"), pieces.where("copies > 0")
    ends = [f(c) for c in ("h1", "h2") for f in (F.min, F.max)]
    alive = pieces.groupBy("key").agg(F.sum("copies").alias("m"), *[e.alias(f"e{i}") for i, e in enumerate(ends)])
    alive = alive.where("m > 1").select("key", F.expr("e0 = e1 and e2 = e3").alias("alike"))
    met = stage(pieces.join(alive, "key"), "met")
    whole, apart = met.where("alike"), met.where("not alike")
    found = F.array(F.struct(F.lit(0).cast("long").alias("start"), "n")).alias("ranges")
    out = known.unionByName(whole.select(*NAMES)).select("row", "start", found)
    different = apart.groupBy("key", "h1", "h2").agg(F.sum("copies").alias("copies"), F.min(F.struct("row", "start", "n")).alias("one"))
    last = len(width) == 1
    sizes = different.groupBy("key").agg((F.lit(not last) & (F.count("*") > group)).alias("large"))
    wanted = different.join(sizes, "key").select("key", "h1", "h2", "copies", "large", "one.*")
    cut = stage(_cut(texts, wanted, length), "cut")
    ranges = _by_suffixes(cut.where("not large"), length)
    if not last and not cut.where("large").isEmpty():
        large = stage(cut.where("large").withColumn("row", F.monotonically_increasing_id()), "large")
        again = repeated_ranges(large.select("row", "copies", "text"), length, group, level + 1)
        moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), r["n"].alias("n")))
        again = again.groupBy("row").agg(F.flatten(F.collect_list(moved)).alias("ranges"))
        ranges = ranges.unionByName(large.join(again, "row").select("h1", "h2", "ranges"))
    # Pieces that have a copy in their own batch are known already.
    return out.unionByName(apart.where("copies = 1").join(ranges, ["h1", "h2"]).select("row", "start", "ranges"))


KEPT = "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """Every text without the bytes that lie in a string of ``length`` bytes which also starts anywhere else.

    Texts are UTF-8 bytes, and strings never reach over the end of a text; strings that overlap and those within
    one text count, and all are judged on the whole input. Returns a row for each row of ``docs``: ``key`` (an
    integer), n_bytes, spans (removed ranges, maximal, ends exclusive) and kept (the bytes that remain; a cut may
    lie within a character). Null texts are empty; null keys stay null; repeated rows and keys are texts like
    others (of two equal texts both go); other columns are not read; no rows give no rows. Memory in a task grows
    with the longest single text.
    """
    small_batches()
    rows = stage(docs.select(
        ref(key).cast("long").alias("key"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row")), "texts")
    long = rows.where(F.octet_length("text") >= length).select("row", F.lit(1).cast("long").alias("copies"), "text")
    # At most as many ranges as the text has bytes.
    marked = repeated_ranges(long, length, group).groupBy("row").agg(F.collect_list(F.struct("start", "ranges")).alias("marks"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, marks in zip(batch.column(1), batch.column(2)):
                data = text.as_buffer().to_pybytes()
                size, found, rest, at = len(data), [], [], 0
                marks = marks.as_py() or []
                for a, n in sorted((m["start"] + r["start"], r["n"]) for m in marks for r in m["ranges"]):
                    b = a + n + length - 1
                    if found and a <= found[-1]["end"]:
                        found[-1]["end"] = max(b, found[-1]["end"])
                    else:
                        found.append({"start": a, "end": b})
                for s in found:
                    rest.append(data[at:s["start"]])
                    at = s["end"]
                sizes.append(size)
                spans.append(found)
                kept.append(b"".join([*rest, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                ["key", "n_bytes", "spans", "kept"])

    joined = rows.join(marked, "row", "left").select("key", "text", "marks")
    return joined.mapInArrow(remove, KEPT).withColumnRenamed("key", key)
