"""Near-duplicate documents: MinHash bands find candidates, odd sketches screen them, full sets confirm them.

Texts with the same shingle set are one class from the start, so copies are never compared. Between classes:

1. Banded MinHash puts classes into buckets. A bucket offers its members to the one with the least id, its
   leader; the hood of a leader are the members of all its buckets. No pairs within a bucket are listed.
2. Every member is compared with its leader, in blocks of bounded size: the odd sketches first, then the full
   sets. Links found give the first components.
3. What this can miss are links between members of one hood in different components. Members outside the
   component that most of a hood belongs to are compared with all of the hood that is not in their own
   component, again in blocks, so the work grows with the outsiders, not with the square of the hood.
4. Components of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse.llm.common import free_name, ref, text_udf
from newspulse.llm.components import components
from newspulse.session import stage

MIX = np.uint64(0x9E3779B97F4A7C15)
WHOLE = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """``similarity`` in percent; ``bands`` of ``rows`` MinHash values find a pair at it with probability 0.99994.

    ``screen`` is the estimate below which an odd sketch rules a pair out, four standard deviations under 0.75.
    A block compares up to ``left`` with up to ``right`` sets, ``most`` shingles a side. Up to ``small`` ids of
    documents with candidates are broadcast; beyond that the texts are shuffled to them.
    """

    shingle: int = 5
    similarity: int = 75
    bands: int = 36
    rows: int = 5
    bits: int = 512
    screen: float = 0.57
    left: int = 256
    right: int = 1024
    most: int = 1_000_000
    small: int = 200_000
    seed: int = 20


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit names of the word shingles; the whole sequence is one if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    short = len(ids) < size
    size = min(size, len(ids))
    names = ids[:len(ids) - size + 1].copy()
    for j in range(1, size):
        names = names * MIX + ids[j:len(ids) - size + 1 + j]
        names ^= names >> np.uint64(29)
    if short:
        names = names * WHOLE + np.uint64(size)
    return np.unique(names)


class Sketcher:
    """MinHash values of shingle sets, their band keys and their odd sketch."""

    def __init__(self, s: Settings):
        self.s = s
        draw = np.random.default_rng(s.seed)
        n = s.bands * s.rows
        self.flip = draw.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.times = (draw.integers(0, 2**32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.place = draw.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)

    def minhash(self, names: np.ndarray) -> np.ndarray:
        low = (names >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.flip), 2**32 - 1, np.uint32)
        for at in range(0, len(low), 2048):
            mixed = (low[at:at + 2048] ^ self.flip) * self.times
            mixed ^= mixed >> np.uint32(15)
            np.minimum(least, mixed.min(1), out=least)
        return least

    def bands(self, least: np.ndarray) -> list[int]:
        """One 64-bit key for each band."""
        rows = least.reshape(self.s.bands, self.s.rows).astype(np.uint64)
        key = np.arange(1, self.s.bands + 1, dtype=np.uint64) * WHOLE
        for j in range(self.s.rows):
            key = (key ^ rows[:, j]) * MIX
            key ^= key >> np.uint64(31)
        return key.view(np.int64).tolist()

    def odd(self, least: np.ndarray) -> bytes:
        """Parity bitmap: each MinHash value, with its place, flips one bit."""
        where = ((least.astype(np.uint64) + np.uint64(1)) * self.place) >> np.uint64(40)
        parity = np.bincount((where % np.uint64(self.s.bits)).astype(np.int64), minlength=self.s.bits) & 1
        return np.packbits(parity.astype(np.uint8)).tobytes()

    def most_flips(self, similarity: float) -> float:
        """Differing bits expected of a pair of this similarity; fewer means more alike."""
        n, apart = self.s.bits, 2 * len(self.flip) * (1 - similarity)
        return n / 2 * (1 - np.exp(-2 * apart / n))


MARKS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])
SETS = T.StructType([
    T.StructField("odd", T.BinaryType()), T.StructField("items", T.BinaryType()),
])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def marks(s: Settings) -> Callable[[Column], Column]:
    """Size, class (a 128-bit hash of the set) and band keys of a text; all but the size null for an empty set."""
    def make():
        sketch = Sketcher(s)

        def one(text):
            names = shingles(text, s.shingle)
            if not len(names):
                return 0, None, None
            return len(names), xxhash.xxh3_128_digest(names.tobytes()), sketch.bands(sketch.minhash(names))
        return one

    return text_udf(make, MARKS)


def sets(s: Settings) -> Callable[[Column], Column]:
    """Odd sketch and full set of a text."""
    def make():
        sketch = Sketcher(s)

        def one(text):
            names = shingles(text, s.shingle)
            return sketch.odd(sketch.minhash(names)), names.tobytes()
        return one

    return text_udf(make, SETS)


def compare_block(s: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between the left and the right rows of one block (node, part, left, odd, items).

    Pairs of one part are passed over; of the links of a left node to a part one is enough.
    """
    limit = Sketcher(s).most_flips(s.screen)
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint16)

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(x, np.uint64) for x in block["items"]]
        odd = np.frombuffer(b"".join(block["odd"]), np.uint8).reshape(len(block), -1)
        node, part = block["node"].to_numpy(), block["part"].to_numpy()
        size = np.array([len(x) for x in names])
        right = np.flatnonzero(~block["left"].to_numpy())
        found = []
        for i in np.flatnonzero(block["left"].to_numpy()):
            small, large = np.minimum(size[right], size[i]), np.maximum(size[right], size[i])
            near = right[(part[right] != part[i]) & (100 * small >= s.similarity * large)]
            flips = ones[odd[near] ^ odd[i]].sum(1)
            near, flips = near[flips <= limit], flips[flips <= limit]
            done = set()
            for j in near[np.argsort(flips, kind="stable")]:
                if part[j] in done:
                    continue
                both = len(np.intersect1d(names[i], names[j], assume_unique=True))
                if 100 * both >= s.similarity * (size[i] + size[j] - both):
                    done.add(part[j])
                    found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def _blocks(rows: DataFrame, content: DataFrame, s: Settings) -> DataFrame:
    """Links of all blocks; ``rows`` holds the block, node, part and side of each set to be compared there."""
    full = rows.join(content, "node")
    return full.groupBy("hood", "l", "r").applyInPandas(
        lambda block: compare_block(s)(block), LINKS,  # noqa: PLW0108
    )


def _spread(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Deal the rows (hood, node, part, left, right) of each hood to its blocks.

    A left row goes to one block row and all its columns, a right row to one column and all its block rows.
    """
    dealt = rows.join(sizes, "hood")
    own_l, own_r = F.pmod(F.xxhash64("node"), "n_l"), F.pmod(F.xxhash64("node"), "n_r")
    all_l, all_r = F.sequence(F.lit(0), F.col("n_l") - 1), F.sequence(F.lit(0), F.col("n_r") - 1)
    lefts = dealt.where("left").withColumn("l", own_l.cast("long")).withColumn("r", F.explode(all_r.cast("array<long>")))
    rights = dealt.where("right").withColumn("r", own_r.cast("long")).withColumn("l", F.explode(all_l.cast("array<long>")))
    keep = ["hood", "l", "r", "node", "part"]
    return lefts.select(*keep, F.lit(True).alias("left")).union(rights.select(*keep, F.lit(False).alias("left")))


def _n_blocks(rows: Column, shingles_in: Column, most_rows: int, s: Settings) -> Column:
    return F.greatest(F.ceil(rows / most_rows), F.ceil(shingles_in / s.most), F.lit(1)).cast("long")


def _links(docs: DataFrame, classes: DataFrame, key: str, text: str, s: Settings) -> DataFrame | None:
    """Links between classes; ``classes`` has node, n and bands."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("node").alias("hood"), F.count("*").alias("many")).where("many > 1")
    hoods = stage(
        banded.join(leaders.drop("many"), "band").where("node > hood").select("hood", "node").distinct(), "hoods"
    )
    wanted = hoods.select("node").union(hoods.select("hood")).distinct()
    wanted = stage(wanted, "wanted")
    if wanted.isEmpty():
        return None
    few = wanted.count() <= s.small
    content = stage(
        docs.join(F.broadcast(wanted) if few else wanted, ref(key) == F.col("node"), "left_semi")
        .select(ref(key).alias("node"), sets(s)(ref(text)).alias("set"))
        .select("node", "set.odd", "set.items").where(F.length("items") > 0),
        "sets",
    )
    size = classes.select("node", "n")

    members = hoods.join(size, "node")
    star = members.select("hood", "node", F.col("node").alias("part"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    star = star.union(hoods.select("hood").distinct().select(
        "hood", F.col("hood"), F.lit(-1), F.lit(True), F.lit(False)).toDF(*star.columns))
    sizes = members.groupBy("hood").agg(F.count("*").alias("m"), F.sum("n").alias("k")).select(
        "hood", F.lit(1).cast("long").alias("n_l"), _n_blocks(F.col("m"), F.col("k"), s.right, s).alias("n_r"))
    first = stage(_blocks(_spread(star, sizes), content, s), "links")

    parts = components(first)
    everyone = hoods.union(hoods.select("hood", F.col("hood")).distinct()).toDF("hood", "node")
    placed = stage(
        everyone.join(parts, "node", "left").join(size, "node")
        .select("hood", "node", "n", F.coalesce("root", "node").alias("part")), "placed"
    )
    per_part = placed.groupBy("hood", "part").agg(F.count("*").alias("m"), F.sum("n").alias("k"))
    # Two members are the leader and one that was compared with it.
    open_hoods = per_part.groupBy("hood").agg(
        F.max_by("part", F.struct("m", "part")).alias("home"), F.max("m").alias("most"), F.sum("m").alias("m"),
        F.sum("k").alias("k"), F.sum("k").alias("all_k"),
    ).where("m > most and m > 2").select(
        "hood", "home",
        _n_blocks(F.col("m") - F.col("most"), F.col("k"), s.left, s).alias("n_l"),
        _n_blocks(F.col("m"), F.col("all_k"), s.right, s).alias("n_r"),
    )
    rest = placed.join(open_hoods.select("hood", "home"), "hood").select(
        "hood", "node", "part", (F.col("part") != F.col("home")).alias("left"), F.lit(True).alias("right"))
    second = _blocks(_spread(rest, open_hoods.drop("home")), content, s)
    return first.union(stage(second, "links"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Size of the shingle set, component and verdict of each row of ``docs``.

    Returns ``key``, ``n_shingles``, ``component_id`` (the least key reachable over links, its own included) and
    ``kept`` (the row has that key). ``key`` is an integer. Rows that share a key are one node of the graph, and
    repeated rows stay repeated. Null and empty texts have an empty set, are linked with nothing and kept. A null
    key is no node: such a row gets the component of the texts it is like, null if it has no like with a key,
    and is kept only then. Other columns are not read; an empty table gives an empty result.
    """
    s = settings
    narrow = docs.select(ref(key).alias("key__"), ref(text).cast("string").alias("text__"))
    marked = stage(narrow.select("key__", marks(s)(F.col("text__")).alias("m")).select("key__", "m.*"), "marks")
    same = marked.where("cls is not null").groupBy("cls").agg(F.min("key__").alias("node"))
    same = stage(same.where("node is not null"), "classes")
    classes = marked.join(same, "cls").where("key__ = node").select("node", "n", "bands")
    links = _links(narrow, classes, "key__", "text__", s)
    # A key with several texts ties their classes together.
    tied = marked.join(same, "cls").where("key__ <> node").select(F.col("key__").alias("a"), F.col("node").alias("b"))
    several = marked.where("cls is not null").groupBy("key__").agg(F.min("cls").alias("x"), F.max("cls").alias("y"))
    tied = tied.join(several.where("x <> y").select(F.col("key__").alias("a")), "a", "left_semi").select("a", "b")
    roots = components(tied if links is None else links.union(tied))
    out = marked.select("key__", "n", "cls").join(same, "cls", "left")
    out = out.withColumn("node", F.when(F.col("key__").isNull() | F.col("node").isNotNull(), F.col("node")).otherwise(F.col("key__")))
    out = out.join(roots, "node", "left").withColumn("component_id", F.coalesce("root", "node"))
    return out.select(
        F.col("key__").alias(key), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("key__") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are kept: of each group those with the least key, with their columns unchanged.

    Rows without a key stay if their text is like none that has one.
    """
    gone = near_duplicates(docs, text, key, settings).where(~F.col("kept"))
    lost = free_name(docs, "gone")
    gone = gone.groupBy(F.col(key).alias(lost)).count().select(lost)
    return docs.join(gone, ref(key).eqNullSafe(ref(lost)), "left_anti")
