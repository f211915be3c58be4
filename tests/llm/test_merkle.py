"""The Merkle manifest against a tree built by hand."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from test_llm_operators import empty, odd  # noqa: F401

from newspulse.llm import merkle
from newspulse.llm.merkle import manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return sha256("".join(parts).encode("utf-8")).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """Levels of a tree, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i:i + 2]) for i in range(0, len(now), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        at = i ^ 1
        out.append((level[at] if at < len(level) else "", at < i))
        i //= 2
    return out


def folded(start, way):
    for sibling, left in way:
        start = h(sibling, start) if left else h(start, sibling)
    return start


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        here = [r for r in rows if r[2] == lang]
        here = sorted(here, key=lambda r: (r[0] is not None, r[0] or 0, h(*map(enc, r))))
        trees[lang] = here, tree([h(*map(enc, r)) for r in here])
    top = tree([trees[lang][1][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        here, levels = trees[lang]
        for i, r in enumerate(here):
            way = siblings(levels, i) + siblings(top, place)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            start = h(*map(enc, (*r[:3], r[3] + 1, r[4]))) if hit else levels[0][i]
            up = folded(start, way)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], h(*[s for s, _ in way]), up, up == top[-1][0]))
    return out


def check(df, step=None):
    seventh = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = manifest(df, tampered={"n_chars": F.when(seventh, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    assert got.columns == COLUMNS
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in df.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17])
def test_small_trees(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    rows = [(i * 3, f"s{i % 2}", ["en", None, "de"][i % 3] if n > 3 else "en", i, f"text {i} é") for i in range(n)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_a_hot_tree_beside_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 3)
    rows = [(i, "s", "en", i, f"t{i}") for i in range(700)] + [(1000 + i, None, f"l{i}", None, None) for i in range(40)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_more_leaves_than_a_stored_step(spark):
    rows = [(i, "s", "en" if i % 9 else "", i, f"t{i}") for i in range(600)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_odd_rows(spark, odd, empty):  # noqa: F811
    check(odd)
    check(odd.unionByName(odd).repartition(3))
    none = manifest(empty)
    assert none.columns == COLUMNS and none.count() == 0


def test_untampered_rows_are_verified(odd):  # noqa: F811
    got = manifest(odd)
    assert got.where("verified").count() == odd.count()
    assert got.sparkSession.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_more_steps_than_the_default_limit_of_rows(spark):
    """The recursive query counts rows of all steps; the limit is lifted while it runs."""
    rows = spark.range(400).select("id", F.lit("en").alias("lang"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = manifest(rows, ("id", "lang"), key="id")
        assert got.where("verified").count() == 400
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "100"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_levels_and_climbs_take_tasks_by_their_rows(spark, monkeypatch):
    """Not one Python task and file for each of very many shuffle partitions."""
    files, real = {}, merkle.stage

    def staged(df, name, *rest):
        out = real(df, name, *rest)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(merkle, "stage", staged)
    most = spark.sparkContext.defaultParallelism
    few = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        check(spark.createDataFrame([(i, "s", "abc"[i % 3], i, f"text {i}") for i in range(2000)], SCHEMA))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files["nodes"]) == 3 and max(files["nodes"]) <= most and files["climbed"] == [files["climbed"][0]]
    assert files["climbed"][0] <= most
    monkeypatch.setattr(merkle, "ROWS", 100)
    assert merkle._few_tasks(spark.range(0, 10, 1, 50), 1000).rdd.getNumPartitions() == 10
