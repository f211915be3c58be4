"""Names of any length, pages in bytes, and JSON of unknown shape."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse.functions.encoding import decoded, encoding_of, lenient
from newspulse.operators import entities as E
from newspulse.resources import words
from newspulse.sources import readers, variants

TOKEN = re.compile(r"\w+(?:['’-]\w+)*|[.,;:!?|()\"]")


def brute(text, names):
    tokens = TOKEN.findall(text or "")
    out, free = [], 0
    for pos in range(len(tokens)):
        hits = [n for n in names if [t.lower() for t in tokens[pos:pos + len(n)]] == list(n)]
        if hits and pos >= free:
            best = max(hits, key=len)
            out.append((pos, " ".join(tokens[pos:pos + len(best)]), names[best]))
            free = pos + len(best)
    return out


def found(spark, texts, rows):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lists = E.mention_lists(df, "id", "t", words.gazetteer(spark, rows))
    return {r.id: [(m.pos, m.text, m.label) for m in r.entities] for r in lists.collect()}


NAMES = [
    ("european central bank", "ORG"), ("european central bank of issue", "ORG"), ("bank of", "LOC"), ("of issue and more", "MISC"),
    ("a", "X"), ("a b c d e f g", "Y"), ("b", "Z"), ("u.s. steel", "ORG"), ("d'or", "PER"),
]


def test_names_of_any_length(spark):
    got = found(spark, [
        "The European Central Bank of issue, and European central bank of", "european central", None, "", "a b c d e f h",
        "a b c d e f g", "Works of U.S. Steel", "of issue and more",
    ], NAMES)
    assert got == {
        0: [(1, "European Central Bank of issue", "ORG"), (8, "European central bank", "ORG")],
        4: [(0, "a", "X"), (1, "b", "Z")], 5: [(0, "a b c d e f g", "Y")], 6: [(2, "U . S . Steel", "ORG")],
        7: [(0, "of issue and more", "MISC")],
    }


@pytest.mark.parametrize("small", [0, 20_000])
def test_names_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(E, "SMALL_INDEX", small)
    draw = random.Random(4)
    rows = {" ".join(draw.choice("abc") for _ in range(draw.randint(1, 9))): f"l{i}" for i in range(60)}
    texts = [" ".join(draw.choice("abcd") for _ in range(draw.randint(0, 120))) for _ in range(40)]
    texts.append(" ".join("abc"[i % 3] for i in range(5000)))
    names = {tuple(s.split()): label for s, label in rows.items()}
    assert found(spark, texts, list(rows.items())) == {i: m for i, t in enumerate(texts) if (m := brute(t, names))}


def test_empty_gazetteer_and_repeated_names(spark):
    df = spark.createDataFrame([(0, "New York")], "id int, t string")
    none = words.gazetteer(spark, [])
    assert E.mention_lists(df, "id", "t", none).count() == 0
    twice = spark.createDataFrame([("new  york", "B"), ("New York", "A"), ("", "C"), (None, "D")], "surface string, label string")
    rows = E.mention_lists(df, "id", "t", twice).collect()
    assert [(m.text, m.label) for m in rows[0].entities] == [("New York", "A")]
    index = E.prefix_index(twice)
    assert [tuple(r) for r in index.orderBy("depth").collect()] == [(1, "", "new", "new", 2, None), (2, "new", "york", "new york", 2, "A")]
    assert E.mention_lists(df, "id", "t", index).count() == 1


def test_scores_of_any_size(spark):
    rows = [(1, 12.5, "A"), (2, 0.12345678, "A"), (3, -100.25, "B"), (4, None, "B")]
    df = spark.createDataFrame(rows, "id int, p double, e string").select(
        "id", "p", F.array(F.struct(F.lit(0).alias("pos"), F.col("e").alias("text"), F.lit("X").alias("label"))).alias("entities"))
    got = {r.Entity: r for r in E.entity_polarity(df, "id", ["p"]).collect()}
    assert (got["A"].mean_p, got["A"].count_p, got["A"].p) == ((12.5 + 0.12345678) / 2, 2, 12.5)
    assert got["A"].var_p == pytest.approx((12.5 - 0.12345678) ** 2 / 2)
    assert (got["B"].mean_p, got["B"].var_p, got["B"].count_p) == (-100.25, None, 1)


# ---- pages in bytes -----------------------------------------------------------------------------

PAGE = "<html><head>{meta}</head><body><h1>Rødgrød — på</h1><article>Æble “citat” 5 €</article></body></html>"
LATIN = "<html><head>{meta}</head><body><h1>Rødgrød på</h1><article>Æble é</article></body></html>"


@pytest.mark.parametrize("data, encoding", [
    (PAGE.format(meta="").encode("utf-8"), "utf-8"),
    (b"\xef\xbb\xbf" + PAGE.format(meta="<meta charset=latin1>").encode("utf-8"), "utf-8"),
    (b"\xff\xfe" + PAGE.format(meta="").encode("utf-16-le"), "utf-16le"),
    (b"\xfe\xff" + PAGE.format(meta="").encode("utf-16-be"), "utf-16be"),
    (PAGE.format(meta='<META http-equiv=x content="text/html; CharSet=Windows-1252">').encode("cp1252"), "windows-1252"),
    (PAGE.format(meta="<meta charset = 'ISO-8859-1' >").encode("cp1252"), "windows-1252"),
    (LATIN.format(meta="").encode("latin-1"), "windows-1252"),
    (LATIN.format(meta="<meta charset=klingon>").encode("latin-1"), "windows-1252"),
    (PAGE.format(meta="<meta charset=utf-16>").encode("utf-8"), "utf-8"),
    (b'<?xml version="1.0" encoding="iso-8859-1"?>' + LATIN.format(meta="").encode("latin-1"), "windows-1252"),
])
def test_encodings(spark, tmp_path, data, encoding):
    (tmp_path / "a.html").write_bytes(data)
    row = readers.html_pages(spark, str(tmp_path)).first()
    python = {"windows-1252": "cp1252", "utf-8": "utf-8-sig", "utf-16le": "utf-16", "utf-16be": "utf-16"}[encoding]
    assert (row.encoding, row.html) == (encoding, data.decode(python))
    assert row.url.endswith("a.html")


def test_malformed_bytes_do_not_end_the_job(spark):
    rows = [
        (0, b"<meta charset=utf-8>\xff\xfeabc\x80"), (1, b"\xff\xfea\x00\x00\xd8b\x00c"), (2, b""), (3, None), (4, b"\xfe\xff"), (5, b"\xef\xbb\xbf"),
        (6, b"x" * 1020 + b"<meta charset=utf-8>\xe6"),
    ]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: (r.encoding, r.html) for r in readers.decoded_pages(df).collect()}
    assert got[0][0] == "utf-8" and got[0][1].endswith("abc�")
    assert got[1][0] == "utf-16le" and got[1][1].startswith("a\ufffd")  # half a pair
    assert got[2] == ("utf-8", "") and got[3][1] is None and got[4] == ("utf-16be", "") and got[5] == ("utf-8", "")
    assert got[6] == ("windows-1252", "x" * 1020 + "<meta charset=utf-8>æ")
    assert spark.conf.get(lenient.NAME) == "false"
    assert df.select(encoding_of(F.col("content")), decoded(F.col("content"), F.lit("utf-8"))).count() == 7


# ---- JSON of unknown shape ----------------------------------------------------------------------

DOCS = [
    {"feed": [{"title": "a", "url": "u", "authors": ["x", "y"], "topics": [{"topic": "t", "score": 0.5}], 'odd "key".[0]': {"deep": [1, [2, {}]]}},
              {"title": 5, "authors": "none"}], "items": "2"},
    {"Information": "limit reached"}, {"Note": "wait", "feed": "later"}, [], "text", {"feed": []},
]


def test_every_key_of_a_feed_survives(spark, tmp_path):
    for i, d in enumerate(DOCS):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "9.json").write_text('{"feed": [{"title": "cut')
    items, status = readers.json_feed(spark, str(tmp_path))
    rows = items.select("*", F.to_json("rest").alias("json")).orderBy("title").collect()
    assert [(r.title, r.url, r.authors) for r in rows] == [("5", None, None), ("a", "u", ["x", "y"])]
    assert [json.loads(r.json) for r in rows] == [DOCS[0]["feed"][1], DOCS[0]["feed"][0]]
    got = {r.file_name: (r.valid, r.has_feed, r.message) for r in status.collect()}
    assert got == {
        "0.json": (True, True, None), "1.json": (True, False, "limit reached"), "2.json": (True, False, "wait"),
        "3.json": (True, False, None), "4.json": (True, False, None), "5.json": (True, True, None), "9.json": (False, False, None),
    }
    assert [r.file_name for r in variants.bad_documents(variants.json_documents(spark, str(tmp_path))).collect()] == ["9.json"]


def test_documents_one_per_line(spark, tmp_path):
    (tmp_path / "feed.json").write_text("\n".join([json.dumps(DOCS[0]), "", "{broken", json.dumps(DOCS[1])]))
    documents = variants.json_documents(spark, str(tmp_path), multi_line=False)
    assert documents.count() == 3 and variants.bad_documents(documents).first().raw == "{broken"
    items, status = readers.json_feed(spark, str(tmp_path), multi_line=False)
    assert items.count() == 2 and status.where("valid").count() == 2


def plain(value, path="$"):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from plain(v, path + '["' + k.replace('"', '\\"') + '"]')
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from plain(v, f"{path}[{i}]")
    else:
        yield path, value


def test_leaves_at_any_depth(spark):
    deep = 7
    for i in range(30):
        deep = {"k": deep} if i % 2 else [deep, None]
    docs = [*DOCS, None, True, 1.5, {"a": {}, "b": [], "c": "[{not json", "d": '"\\'}, deep]
    df = variants.parsed(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "{")], "id int, raw string"))
    got = {(r.id, r.path): r.value for r in variants.leaves(df, ["id"], "doc").collect()}
    want = {(i, p): v for i, d in enumerate(docs) for p, v in plain(d)}
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    assert got == {k: text(v) for k, v in want.items()}
    assert variants.leaves(df.limit(0), ["id"], "doc").count() == 0


def test_declared_types_are_tried_not_forced(spark):
    df = variants.parsed(spark.createDataFrame([('{"l": [{"n": "x", "s": 1}, 3, null]}',)], "raw string"))
    fields = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])
    rows = variants.items(df, "l", fields).collect()
    assert [(r.pos, r.n, r.s) for r in rows] == [(0, None, "1"), (1, None, None), (2, None, None)]
