"""Registered queries of this subpackage over the test tables, with the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newspulse.llm import (
    collocations, language, main_text, merkle, mixing, near_dups, packing, phrases, quality_net, quality_rules, secrets,
    suffix_dedup, wavelet,
)
from newspulse.session import stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query()
def op1_quality_net(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality_net.score(docs, quality_net.learn(docs, table(spark, sf, "labels")))


@query()
def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id", *[of(k) for k in secrets.KINDS],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query()
def op3_phrase_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.fingerprint_documents(table(spark, sf, "documents"))


@query()
def op4_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.main_text(table(spark, sf, "pages"))


@query()
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@query()
def op6_wavelet_shards(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "shards")
    wavelet.write_shards(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_documents(spark, path).withColumnRenamed("key", "doc_id")


@query()
def op7_minhash_odd_sketches(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf, "documents"))


@query()
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.identify(docs, language.learn(docs))


@query()
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


@query()
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    placed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return placed.select(
        F.col("key").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# Phrases of two and three words with their counts, by lists of the words of each piece.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
runs AS (
    SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3)) AS t(words)),
f AS (SELECT lang, words, phrase, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
    SELECT lang, words, phrase, n AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM f)),
scored AS (
    SELECT c.lang, c.words, c.phrase, c.a, c.k, l.n AS l, r.n AS r,
        CAST((1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, n
    FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words = 3)),
longer AS (SELECT lang, phrase, max(n) AS most FROM inner_runs GROUP BY ALL),
ranked AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
    FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
    WHERE g.most IS NULL OR 100 * g.most < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query(COLLOCATIONS_SQL)
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query()
def op12_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _encoded_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# CRC-32 of the decimal doc_id, bit by bit; nodes of all levels; then the climb of each leaf.
MERKLE_SQL = f"""
WITH RECURSIVE crc AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
            lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
            lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc FROM documents),
base AS (
    SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
        CASE WHEN crc % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS changed FROM crc),
leaves AS (
    SELECT *, coalesce('1' || lang, '0') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM base),
low AS (
    SELECT tree, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
    FROM low WHERE n > 1 GROUP BY tree, level, idx // 2),
subroots AS (SELECT tree, level AS top, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, place AS idx, subroot AS h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2
    FROM high WHERE n > 1 GROUP BY level, idx // 2),
nodes AS (SELECT tree, level, idx, h FROM low UNION ALL SELECT '', level, idx, h FROM high),
climb AS (
    SELECT doc_id, tree AS own, idx AS leaf_idx, tree, 0 AS level, idx, changed AS folded, '' AS proof FROM leaves
    UNION ALL
    SELECT c.doc_id, c.own, c.leaf_idx,
        CASE WHEN c.level = s.top AND c.tree <> '' THEN '' ELSE c.tree END,
        CASE WHEN c.level = s.top AND c.tree <> '' THEN 0 ELSE c.level + 1 END,
        CASE WHEN c.level = s.top AND c.tree <> '' THEN s.place ELSE c.idx // 2 END,
        CASE WHEN c.level = s.top AND c.tree <> '' THEN c.folded
            WHEN c.idx % 2 = 1 THEN sha256(b.h || c.folded) ELSE sha256(c.folded || coalesce(b.h, '')) END,
        CASE WHEN c.level = s.top AND c.tree <> '' THEN c.proof ELSE c.proof || coalesce(b.h, '') END
    FROM climb c LEFT JOIN subroots s ON s.tree = c.tree
    LEFT JOIN nodes b ON b.tree = c.tree AND b.level = c.level AND b.idx = xor(c.idx, 1)
    WHERE c.tree <> '' OR c.level < (SELECT max(level) FROM high))
SELECT c.doc_id, l.leaf, s.subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.h AS verified
FROM climb c JOIN leaves l ON l.tree = c.own AND l.idx = c.leaf_idx JOIN subroots s ON s.tree = c.own
JOIN (SELECT level, h FROM high WHERE n = 1) r ON r.level = c.level WHERE c.tree = ''"""


@query(MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    # Whoever tampers adds a character to the count of every seventh document.
    seventh = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = {"n_chars": F.when(seventh, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle.manifest(table(spark, sf, "documents"), tampered=tampered)
