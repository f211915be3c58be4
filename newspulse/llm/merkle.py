"""Merkle manifest of a dataset, climbed by a recursive query.

Leaves are hashed, ordered and numbered within their tree; two consecutive nodes become one, level by level, up
to the root of the tree, and the roots of all trees are the leaves of a last one. Built nodes are stored as rows
that link to their ancestor ``STEP`` levels up (or to the root) and hold the siblings on the way there; a
recursive query climbs from every leaf along these links, appends the siblings and folds a hash upwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from hashlib import sha256
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newspulse.llm.common import ref
from newspulse.session import stage

STEP = 8  # levels between two stored ancestors, so 256 nodes share one
ROWS = 1 << 14  # nodes that a task builds or writes, where there are more tasks than the session runs at once
TOP = ""  # the tree over all trees


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    """SHA-256 of the encoded columns, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns]), 256))


def as_text(c: Column | str) -> Column:
    return F.lower(F.hex(c))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in their ``tree`` by ``order``, and ``size``, the rows of the tree.

    Rows are sorted in ranges; windows run over one row for each range and tree, never over rows.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_n").over(whole).alias("size"))
    return placed.join(parts, ["tree", "_part"]).withColumn("idx", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")


def _climbed(hashes: list[bytes], levels: int) -> tuple[list[list[tuple[bytes, bytes]]], bytes]:
    """(siblings left and right of each hash on its way up ``levels`` levels, the node there)."""
    ways: list[list[tuple[bytes, bytes]]] = [[] for _ in hashes]
    now = hashes
    for level in range(levels):
        for i, way in enumerate(ways):
            at = i >> level
            if at & 1:
                way.append((now[at - 1], b""))
            else:
                way.append((b"", now[at + 1] if at + 1 < len(now) else b""))
        texts = [h.hex() for h in now]
        now = [sha256("".join(texts[i:i + 2]).encode()).digest() for i in range(0, len(texts), 2)]
    return ways, now[0]


NODE = "tree string, idx long, size long, hash binary, doc_id long, changed binary, way array<struct<left:binary,right:binary>>, top boolean"
FIELDS = ["tree", "idx", "size", "hash", "doc_id", "changed"]


def _few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks of ``ROWS`` rows, but in no fewer than run at once.

    Without it a level of a few hundred nodes takes as many Python tasks and files as the session has shuffle
    partitions, and a climb as many files as the rows of all its steps have partitions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))


def _built(nodes: DataFrame, rows: int) -> DataFrame:
    """The rows with their ``way`` up, and a row with ``top`` for the ancestor that up to 2^STEP of them share."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = pa.struct([("left", pa.binary()), ("right", pa.binary())])
        schema = pa.schema([
            ("tree", pa.string()), ("idx", pa.int64()), ("size", pa.int64()), ("hash", pa.binary()), ("doc_id", pa.int64()),
            ("changed", pa.binary()), ("way", pa.list_(side)), ("top", pa.bool_())])

        def page(rows: list[tuple]) -> list[tuple]:
            tree, first, size = rows[0][:3]
            levels = min(STEP, (size - 1).bit_length())
            ways, top = _climbed([r[3] for r in rows], levels)
            up = (size + (1 << STEP) - 1) >> STEP
            out = [(*r, [{"left": a, "right": b} for a, b in way], False) for r, way in zip(rows, ways)]
            return [*out, (tree, first >> STEP, up, top, None, None, [], True)]

        def record(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        here, out = [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if here and (r[0] != here[0][0] or r[1] >> STEP != here[0][1] >> STEP):
                    out += page(here)
                    here = []
                    if len(out) >= 1024:
                        yield record(out)
                        out = []
                here.append(r)
        out += page(here) if here else []
        if out:
            yield record(out)

    dealt = nodes.select(*FIELDS).withColumn("_page", F.shiftright("idx", STEP))
    dealt = dealt.repartition("tree", "_page").sortWithinPartitions("tree", "idx").drop("_page")
    return _few_tasks(dealt, rows).mapInArrow(build, NODE)


def _levels(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame | None, int]:
    """(stored node rows, one table for every ``STEP`` levels; the root of each tree; leaves), of numbered leaves."""
    most, n_leaves = leaves.agg(F.max("size"), F.count(F.lit(1))).first()
    levels, roots, rows = [], [], n_leaves
    while most:
        built = stage(_built(leaves, rows), "nodes")
        levels.append(built.where("not top"))
        tops = built.where("top")
        roots.append(tops.where("size = 1").select("tree", "hash"))
        leaves, most = tops.where("size > 1"), (most + (1 << STEP) - 1) >> STEP if most > 1 << STEP else 0
        rows >>= STEP - 1  # trees that go on have more than 2^STEP nodes, so at most that many are left
    every = roots[0] if roots else None
    for r in roots[1:]:
        every = every.unionByName(r)
    return levels, every, n_leaves


FOLD = """unhex(aggregate({way}, lower(hex({start})),
    (acc, s) -> sha2(concat(lower(hex(s.left)), acc, lower(hex(s.right))), 256)))"""
SIBLINGS = "aggregate({way}, X'', (acc, s) -> concat(acc, s.left, s.right))"

# One step of a leaf: from the node it has reached to the stored ancestor of that node.
CLIMB = f"""
WITH RECURSIVE climb(tree, doc_id, hash, at_tree, at_level, at_idx, folded, proof) AS (
    SELECT tree, doc_id, hash, up_tree, up_level, up_idx,
        {FOLD.format(way='way', start='changed')}, {SIBLINGS.format(way='way')}
    FROM {{leaves}}
    UNION ALL
    SELECT c.tree, c.doc_id, c.hash, n.up_tree, n.up_level, n.up_idx,
        {FOLD.format(way='n.way', start='c.folded')}, concat(c.proof, {SIBLINGS.format(way='n.way')})
    FROM climb c JOIN {{nodes}} n ON c.at_tree = n.tree AND c.at_level = n.level AND c.at_idx = n.idx
)
SELECT tree, doc_id, hash, folded, proof FROM climb WHERE at_tree IS NULL"""


def climbed(spark: SparkSession, leaves: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """(tree, doc_id, hash, folded, proof) of every leaf, stored; ``folded`` and ``proof`` as they are at the root."""
    # The query gives a row for each leaf and step; by default it stops at a million rows.
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return stage(_few_tasks(spark.sql(CLIMB, leaves=leaves, nodes=nodes), rows), "climbed")
    finally:
        spark.conf.set(name, before)


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang",
    key: str = "doc_id", tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """Leaf, root and proof of every row, and the root that a tampered copy of it leads to.

    A leaf is the hash of ``columns``. Leaves of equal ``tree`` value ascend by ``key`` (an integer, null first;
    rows with one key by their hash) and form a tree; the roots of the trees, null first and then by bytes, form
    the last one. ``tampered`` replaces columns by expressions before a second hash is made, which is folded
    upwards with the original siblings; without it that is the leaf itself. Returns ``key``, leaf, subroot, root,
    proof_sha256 (of all siblings from the leaf to the root), folded_root and verified, the digests as hex text.
    Nulls are ``-`` in a hash; repeated rows are leaves like others; other columns are not read; no rows give no
    rows.
    """
    spark = docs.sparkSession
    changed = [(tampered or {}).get(c, ref(c)) for c in columns]
    hashed = docs.select(
        F.coalesce(F.concat(F.lit("1"), ref(tree).cast("string")), F.lit("0")).alias("tree"), ref(key).cast("long").alias("doc_id"),
        digest(*map(ref, columns)).alias("hash"), digest(*changed).alias("changed"))
    # Rows alike in all are told apart by a stored number, so that very many of them make several ranges.
    hashed = stage(hashed.withColumn("tie", F.monotonically_increasing_id()), "hashes")
    leaves = _numbered(hashed, ["doc_id", "hash", "tie"]).drop("tie")
    levels, roots, n_leaves = _levels(leaves)
    if roots is None:
        text = F.lit(None).cast("string")
        names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        return docs.limit(0).select(
            ref(key).cast("long").alias(key), *[text.alias(c) for c in names], F.lit(None).cast("boolean").alias("verified"))
    roots = roots.withColumnRenamed("tree", "name")
    trees = stage(_numbered(roots.withColumn("tree", F.lit(TOP)), ["name"]), "trees")
    empty = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed")]
    top_levels, top_root, _ = _levels(trees.select("tree", "idx", "size", "hash", *empty))
    root = top_root.first()["hash"].hex()

    places = trees.select(F.col("name").alias("tree"), F.col("idx").alias("place"))
    last = F.col("size") <= 1 << STEP
    up = lambda end, way: F.when(last, end).otherwise(way)

    def linked(level: int, rows: DataFrame, top: bool) -> DataFrame:
        nothing = F.lit(None)
        if not top:
            rows = rows.join(places, "tree")
        return rows.select(
            "tree", F.lit(level).alias("level"), "idx", "way", "hash", "changed", "doc_id",
            up(nothing if top else F.lit(TOP), F.col("tree")).cast("string").alias("up_tree"),
            up(nothing if top else F.lit(0), F.lit(level + 1)).cast("int").alias("up_level"),
            up(nothing if top else F.col("place"), F.shiftright("idx", STEP)).cast("long").alias("up_idx"))

    nodes = [linked(i, rows, False) for i, rows in enumerate(levels) if i] + [linked(i, rows, True) for i, rows in enumerate(top_levels)]
    stored = nodes[0]
    for n in nodes[1:]:
        stored = stored.unionByName(n)
    found = climbed(spark, linked(0, levels[0], False), stage(stored, "links"), n_leaves)
    subroots = trees.select(F.col("name").alias("tree"), F.col("hash").alias("subroot"))
    out = found.join(subroots, "tree")
    return out.select(
        F.col("doc_id").alias(key), as_text("hash").alias("leaf"), as_text("subroot").alias("subroot"), F.lit(root).alias("root"),
        F.sha2(as_text("proof"), 256).alias("proof_sha256"), as_text("folded").alias("folded_root"),
        (as_text("folded") == root).alias("verified"))
