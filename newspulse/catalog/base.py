"""Registry, table access and the SQL pieces that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newspulse.functions import html as H
from newspulse.functions import regex as R
from newspulse.functions import text as X
from newspulse.resources import lexicon as L
from newspulse.resources import words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the role of articles: the source is the outlet, the first line the title."""
    return documents(spark, sf).select(
        "doc_id", F.col("source").alias("medie"), X.first_line("text").alias("title"),
        F.col("text").alias("content"),
    )


# ---- resources matched to the invented words of the test tables ---------------------------------

CORPUS_LEXICON: list[L.Row] = [
    *[(w, v, p, s, "valence") for w, v, p, s in [
        ("thon", "1.7", "0.4", "0.6"), ("attion", "0.9", "0.25", "0.3"), ("erin", "2.3", "0.6", "0.9"),
        ("ertion", "1.1", "0.3", "0.5"), ("queque", "1.4", "0.35", "0.45"), ("einheit", "0.8", "0.2", "0.1"),
        ("eran", "-1.6", "-0.4", "0.7"), ("ther", "-0.7", "-0.15", "0.2"), ("onre", "-2.1", "-0.55", "0.8"),
        ("anea", "-1.3", "-0.3", "0.4"), ("tionment", "-0.9", "-0.2", "0.35"), ("geheit", "-1.8", "-0.45", "0.65"),
    ]],
    *[(w, v, None, None, "booster") for w, v in [("the", "0.293"), ("that", "-0.293"), ("les", "0.293")]],
    *[(w, None, None, None, "negation") for w in ("of", "by", "des", "nicht")],
]
LEXICON_ROWS = L.default_rows() + CORPUS_LEXICON

GAZETTEER_ROWS = words.gazetteer_rows() + [
    ("thon", "ORG"), ("of the", "LOC"), ("the of", "ORG"), ("of the and", "PER"), ("is the", "PER"),
    ("the and of", "MISC"), ("apache license", "LAW"), ("gnu", "LAW"), ("mit", "LAW"), ("de la", "LOC"),
    ("la", "PER"), ("von der", "PER"), ("und die", "ORG"), ("to the", "LOC"), ("erin", "PER"),
]
CLASS_ROWS = words.class_rows() + [("attion", "a"), ("ertion", "r"), ("thon", "v"), ("than", "r"), ("ther", "a")]


def lexicon(spark: SparkSession) -> DataFrame:
    return L.lexicon(spark, LEXICON_ROWS)


def gazetteer(spark: SparkSession) -> DataFrame:
    return words.gazetteer(spark, GAZETTEER_ROWS)


# ---- SQL building blocks ------------------------------------------------------------------------

# Token patterns for the SQL engine, which has no possessive quantifiers.
SQL_TERM = rf"{R.WORD}+(?:'{R.WORD}+)*"
SQL_CHUNK = rf"{R.WORD}(?:[^{R.SPACE_BODY}]*{R.WORD})?"
SQL_PHRASE_TOKEN = rf"{R.WORD}+(?:['’-]{R.WORD}+)*|[.,;:!?|()\x22]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_values(rows: list[tuple], names: str) -> str:
    def cell(x):
        return "NULL" if x is None else str(x) if isinstance(x, int) else lit(x)

    body = ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"


def milli(x: str | None) -> int | None:
    return None if x is None else round(float(x) * 1000)


LEX_SQL = "lex AS (SELECT * FROM " + sql_values(
    [(w, milli(v), milli(p), milli(s), k) for w, v, p, s, k in LEXICON_ROWS], "word, v, p, s, kind"
) + ")"
GAZ_SQL = "gaz AS (SELECT surface, min(label) AS label FROM " + sql_values(GAZETTEER_ROWS, "surface, label") + " GROUP BY 1)"
ART_SQL = "art AS (SELECT doc_id, source AS medie, split_part(text, chr(10), 1) AS title, text AS content FROM documents)"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"


def sql_clean_news(c: str) -> str:
    out = f"replace(coalesce({c}, ''), '{{html}}', ' ')"
    out = sub(sub(sub(out, R.TAG, " "), R.LINK, " "), R.DIGITS, " ")
    return f"replace({sub(out, X.READ_ALOUD, '')}, chr(10), ' ')"


def sql_clean_tech(c: str) -> str:
    out = sub(f"coalesce({c}, '')", rf"[^a-zA-Z0–9{R.SPACE_BODY}]", "")
    out = sub(sub(out, R.LINK, " "), R.DIGITS, " ")
    return sub(f"replace({out}, chr(10), ' ')", r"^\r+|\r+\z", " ")


def sql_squeeze(c: str) -> str:
    out = f"replace({c}, chr(10), ' ')"
    out = f"replace(replace({out}, {lit(X.SPLIT_ELEMENT)}, ' '), chr(160), ' ')"
    return sub(out, " +", " ")


def sql_terms(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), {lit(SQL_TERM)})"


def sql_topic_words(c: str) -> str:
    out = f"replace(lower(coalesce({c}, '')), '{{html}}', '')"
    out = sub(sub(sub(out, R.TAG, ""), R.LINK, ""), "[^A-Za-z ]+", "")
    return f"regexp_extract_all({out}, '[a-z]{{4,}}')"


def sql_decode(c: str) -> str:
    for name, char in H.NAMED_ENTITIES.items():
        c = f"replace({c}, '&{name};', {lit(char)})"
    return f"replace({c}, '&amp;', '&')"


def sql_markup_text(c: str) -> str:
    out = sub(c, r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    return sql_decode(sub(out, "<[^>]*>", ""))


def rdiv(a: str, b: str) -> str:
    """Integer division rounded half away from zero."""
    return f"(CASE WHEN ({a}) < 0 THEN -1 ELSE 1 END * ((2 * abs({a}) + ({b})) // (2 * ({b}))))"


def sql_sum(c: str) -> str:
    """Sum of doubles by their decimal digits, whatever the order of the rows."""
    return f"CAST(CAST(sum(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,15))) AS VARCHAR) AS DOUBLE)"


def sql_mean(c: str) -> str:
    return f"({sql_sum(c)} / count({c}))"


def sql_entities(text: str = "content", source: str = "art", longest: int = 3) -> str:
    """CTE ``ents(doc_id, kept)``: mentions in order, longest match first; needs ``gaz`` and ``source``."""
    nexts = ", ".join(f"lead(a, {i}) OVER w AS a{i}" for i in range(1, longest))
    runs = "".join(
        f" UNION ALL SELECT doc_id, pos, {n}, {' || chr(32) || '.join(['a', *(f'a{i}' for i in range(1, n))])} FROM enext WHERE a{n - 1} IS NOT NULL"
        for n in range(2, longest + 1))
    return f"""
    etok AS (SELECT doc_id, unnest(toks) AS a, unnest(range(len(toks))) AS pos FROM
        (SELECT doc_id, regexp_extract_all({text}, {lit(SQL_PHRASE_TOKEN)}) AS toks FROM {source})),
    enext AS (SELECT doc_id, pos, a, {nexts} FROM etok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    ecand AS (SELECT doc_id, pos, 1 AS n, a AS t FROM enext{runs}),
    ematch AS (SELECT doc_id, pos, n, t, label FROM ecand JOIN gaz ON lower(t) = surface),
    elist AS (SELECT doc_id, list({{'pos': pos, 'n': n, 't': t, 'label': label, 'free': 0::BIGINT,
            'kept': CAST([] AS STRUCT(pos BIGINT, t VARCHAR, label VARCHAR)[])}} ORDER BY pos, n DESC) AS ms
        FROM ematch GROUP BY doc_id),
    ents AS (SELECT doc_id, list_reduce(
            list_prepend({{'pos': (-1)::BIGINT, 'n': 0, 't': '', 'label': '', 'free': 0::BIGINT,
                'kept': CAST([] AS STRUCT(pos BIGINT, t VARCHAR, label VARCHAR)[])}}, ms),
            lambda acc, x: CASE WHEN x.pos >= acc.free THEN {{'pos': x.pos, 'n': x.n, 't': x.t, 'label': x.label,
                'free': x.pos + x.n, 'kept': list_append(acc.kept, {{'pos': x.pos, 't': x.t, 'label': x.label}})}}
                ELSE acc END).kept AS kept
        FROM elist),
    men AS (SELECT doc_id, m.pos AS pos, m.t AS text, m.label AS label FROM (SELECT doc_id, unnest(kept) AS m FROM ents))"""


def sql_strip(c: str) -> str:
    """Entity text without apostrophes, full stops and hyphens; double quotes become spaces."""
    return f"""translate({c}, '"''.-', ' ')"""


def sql_mean_valence(name: str, text: str, source: str = "art", key: str = "doc_id") -> str:
    """CTE ``name(key, hits, score)``: mean valence; needs ``lex`` and ``source``."""
    return f"""
    {name}_t AS (SELECT {key}, unnest({sql_terms(text)}) AS word FROM {source}),
    {name}_h AS (SELECT {key}, v FROM {name}_t JOIN lex USING (word) WHERE kind = 'valence'),
    {name} AS (SELECT d.{key}, count(v) AS hits, CASE WHEN count(v) = 0 THEN 0.0::DOUBLE ELSE (CAST(sum(v) AS DOUBLE) / 1000) / count(v) END AS score
        FROM {source} d LEFT JOIN {name}_h USING ({key}) GROUP BY d.{key})"""


def sql_polarity(name: str, text: str, source: str = "art", key: str = "doc_id") -> str:
    """CTE ``name(key, pol, sub)``; a negation one word before turns and halves a hit."""
    return f"""
    {name}_t AS (SELECT {key}, unnest(w) AS word, unnest(range(len(w))) AS i
        FROM (SELECT {key}, {sql_terms(text)} AS w FROM {source})),
    {name}_c AS (SELECT {key}, word, lag(word) OVER (PARTITION BY {key} ORDER BY i) AS before FROM {name}_t),
    {name}_h AS (SELECT {key}, h.s AS s, h.p * CASE WHEN g.word IS NULL THEN 10 ELSE -5 END AS p10
        FROM {name}_c c JOIN lex h ON c.word = h.word AND h.kind = 'valence'
        LEFT JOIN lex g ON c.before = g.word AND g.kind = 'negation'),
    {name} AS (SELECT d.{key},
            CASE WHEN count(p10) = 0 THEN 0.0::DOUBLE ELSE greatest(least((CAST(sum(p10) AS DOUBLE) / 10000) / count(p10), 1), -1) END AS pol,
            CASE WHEN count(p10) = 0 THEN 0.0::DOUBLE ELSE greatest(least((CAST(sum(s) AS DOUBLE) / 1000) / count(p10), 1), 0) END AS sub
        FROM {source} d LEFT JOIN {name}_h USING ({key}) GROUP BY d.{key})"""


def polarity_label_sql(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN 'negative' WHEN {c} = 0 THEN 'neutral' ELSE 'positive' END"
