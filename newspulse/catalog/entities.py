"""Entity mentions and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.catalog.base import (
    ART_SQL, GAZ_SQL, articles, gazetteer, lexicon, lit, query, sql_entities, sql_mean, sql_strip, sql_sum, sql_values,
)
from newspulse.catalog.sentiment import FIELD_CTES, SCORES_SQL, cleaned_fields, scored_articles
from newspulse.functions import regex as R
from newspulse.operators import entities as E
from newspulse.operators import reports
from newspulse.operators import sentiment as N
from newspulse.resources import words
from newspulse.session import stage

TOP_MIN_COUNT, TOP_N = 3, 20

# Licence names and mail addresses in the test tables.
TYPED_PATTERNS = {
    "LICENSE": r"(?:Apache|GNU General Public|MIT) License",
    "EMAIL": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
}

ENT_SQL = f"{ART_SQL}, {GAZ_SQL}, {sql_entities()}"
KEY_TEXT = sql_strip("text")
ENTITY_KEY = f"replace(lower({KEY_TEXT}), ' ', '')"
# Terms of the entity string: words of the mentions, split where the stripped text has no word character.
STRINGS_SQL = f"""strs AS (SELECT doc_id,
    {sql_strip("array_to_string(list_transform(kept, lambda m: m.t), ',')")} AS enti_str FROM ents)"""
TERMS_SQL = f"""{STRINGS_SQL}, terms AS (SELECT doc_id,
    unnest(regexp_extract_all(lower(enti_str), {lit(R.TERM2)})) AS term FROM strs)"""


def lists(spark, sf):
    """(doc_id, entities) of the articles that mention any."""
    return E.mention_lists(articles(spark, sf), "doc_id", "content", gazetteer(spark))


def lists_with_media(spark, sf):
    return E.mention_lists(articles(spark, sf), ["doc_id", "medie"], "content", gazetteer(spark))


@query(f"WITH {ENT_SQL} SELECT doc_id, pos, text, label FROM men")
def entity_mentions(spark, sf):
    return E.mentions(lists(spark, sf), "doc_id")


# Names of up to six words, one inside the other, beginning alike and overlapping.
LONG_NAMES = [
    ("the and attion to thanedble", "ORG"), ("the and attion", "LOC"), ("attion to", "PER"), ("thanedble the", "MISC"),
    ("therhean is the is esndha reedes", "ORG"), ("is the is", "LOC"), ("thesedst in thedones onnt", "ORG"), ("thesedst in", "PER"),
    ("er ntre in onbleea of", "MISC"), ("onbleea of", "LOC"), ("ndnd onre enat in ingor", "ORG"), ("enat", "PER"), ("thonia . bay", "LOC"),
]


@query(f"""WITH {ART_SQL}, gaz AS (SELECT * FROM {sql_values(LONG_NAMES, 'surface, label')}), {sql_entities(longest=6)}
    SELECT doc_id, pos, text, label FROM men""")
def entity_long_names(spark, sf):
    """Mentions of names of any number of words."""
    found = E.mention_lists(articles(spark, sf), "doc_id", "content", words.gazetteer(spark, LONG_NAMES))
    return E.mentions(found, "doc_id")


@query("WITH " + ", ".join(
    f"""p{i} AS (SELECT doc_id, unnest(m) AS text, unnest(range(len(m))) AS ordinal, '{label}' AS label
        FROM (SELECT doc_id, regexp_extract_all(text, {lit(p)}) AS m FROM documents))"""
    for i, (label, p) in enumerate(TYPED_PATTERNS.items())
) + " SELECT doc_id, ordinal, text, label FROM p0 UNION ALL SELECT doc_id, ordinal, text, label FROM p1")
def pattern_mentions(spark, sf):
    return E.pattern_mentions(articles(spark, sf), "doc_id", "content", TYPED_PATTERNS)


@query(f"WITH {ENT_SQL}, {STRINGS_SQL} SELECT doc_id, enti_str FROM strs")
def entity_string(spark, sf):
    return lists(spark, sf).select("doc_id", E.entity_string("entities").alias("enti_str"))


@query(f"WITH {ENT_SQL}, {TERMS_SQL} SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL")
def entity_counts(spark, sf):
    return E.entity_counts(lists(spark, sf), "doc_id")


@query(f"""WITH {ENT_SQL}, {TERMS_SQL} SELECT medie, term, count(*) AS n FROM terms JOIN art USING (doc_id)
    GROUP BY ALL ORDER BY n DESC, medie, term""")
def entity_totals(spark, sf):
    return E.entity_totals(lists_with_media(spark, sf)).orderBy(F.desc("n"), "medie", "term")


TYPES_SQL = f"types AS (SELECT {ENTITY_KEY} AS entity, arg_max(label, doc_id * 1000000 + pos) AS entity_type FROM men GROUP BY 1)"


@query(f"WITH {ENT_SQL}, {TYPES_SQL} SELECT * FROM types")
def entity_type_map(spark, sf):
    return E.entity_types(lists(spark, sf), "doc_id")


def entity_statistics(spark, sf, unit="mention"):
    scored = scored_articles(spark, sf).join(lists(spark, sf), "doc_id")
    return E.entity_sentiment(scored, "medie", unit)


def typed_statistics(spark, sf, unit="mention"):
    """Entity statistics with types. The mention lists feed both, so the texts are matched only once."""
    found = stage(lists(spark, sf), "mentions")
    scored = scored_articles(spark, sf).join(found, "doc_id")
    return E.attach_types(E.entity_sentiment(scored, "medie", unit), E.entity_types(found, "doc_id"))


def _plain(df):
    return df.withColumn("average_sentiment", F.col("average_sentiment").cast("double")).withColumn(
        "average_sentiment_title", F.col("average_sentiment_title").cast("double")
    )


def _stats_sql(entity_rows):
    return f"""once AS ({entity_rows}),
    stats AS (SELECT medie, entity, {sql_mean('c')} AS a, count(*) AS cnt, {sql_mean('t')} AS b
        FROM once JOIN scored USING (doc_id) GROUP BY medie, entity)"""


STATS_SQL = f"{SCORES_SQL}, {GAZ_SQL}, {sql_entities()}, " + _stats_sql(
    f"SELECT DISTINCT doc_id, {ENTITY_KEY} AS entity FROM men"
)
STATS_COLUMNS = """medie, entity, a AS average_sentiment, cnt AS count, b AS average_sentiment_title,
    cnt AS count_title"""


@query(f"WITH {STATS_SQL} SELECT {STATS_COLUMNS} FROM stats ORDER BY average_sentiment, entity, medie")
def entity_media_sentiment(spark, sf):
    return _plain(entity_statistics(spark, sf)).orderBy(
        F.asc_nulls_last("average_sentiment"), "entity", "medie"
    )


@query(f"""WITH {SCORES_SQL}, {GAZ_SQL}, {sql_entities()}, {TERMS_SQL}, {TYPES_SQL},
    {_stats_sql('SELECT DISTINCT doc_id, term AS entity FROM terms')}
    SELECT {STATS_COLUMNS}, entity_type FROM stats LEFT JOIN types USING (entity)""")
def entity_typed(spark, sf):
    return _plain(typed_statistics(spark, sf, "token"))


@query(f"""WITH {STATS_SQL}, {TYPES_SQL}
    SELECT medie, entity_type, {sql_mean('a')} AS mean_average_sentiment
    FROM stats JOIN types USING (entity) WHERE entity_type IS NOT NULL GROUP BY ALL""")
def sentiment_by_type(spark, sf):
    return reports.mean_by(typed_statistics(spark, sf), ["medie", "entity_type"], "average_sentiment")


@query(f"""WITH {STATS_SQL} SELECT {STATS_COLUMNS} FROM stats WHERE cnt > {TOP_MIN_COUNT}
    ORDER BY a DESC, entity, medie LIMIT {TOP_N}""")
def find_top(spark, sf):
    return _plain(reports.find_top(entity_statistics(spark, sf), TOP_MIN_COUNT, TOP_N))


@query(f"""WITH {STATS_SQL} SELECT {STATS_COLUMNS} FROM stats WHERE cnt > {TOP_MIN_COUNT}
    ORDER BY a, entity, medie LIMIT {TOP_N}""")
def find_bottom(spark, sf):
    return _plain(reports.find_bottom(entity_statistics(spark, sf), TOP_MIN_COUNT, TOP_N))


POLARITIES = ["title_clean_polarity", "description_clean_polarity"]


def _entity_polarity(spark, sf, pairing):
    fields = cleaned_fields(spark, sf)
    scored = N.polarities(fields, ["doc_id"], ["title_clean", "description_clean"], lexicon(spark))
    found = E.mention_lists(fields, "doc_id", "content_clean", gazetteer(spark))
    out = E.entity_polarity(scored.join(found, "doc_id"), "doc_id", POLARITIES, pairing)
    return out.select(*[F.col(c).cast("double").alias(c) if c in POLARITIES else c for c in out.columns])


def entity_polarity_sql(pairs, entities="content"):
    from newspulse.catalog.base import LEX_SQL, sql_clean_tech
    stats = []
    for p, f in zip(POLARITIES, ("t", "d")):
        n, s, q = "count(*)", sql_sum(f), sql_sum(f"({f} * {f})")
        stats.append(f"""{s} / {n} AS mean_{p}, CASE WHEN {n} > 1 THEN greatest(({q} - {s} * {s} / {n}) / ({n} - 1), 0) END AS var_{p},
            {n} AS count_{p}, arg_min({f}, doc_id) AS {p}""")
    return f"""WITH {ART_SQL}, {LEX_SQL}, {GAZ_SQL}, {FIELD_CTES},
    clean AS (SELECT doc_id, {sql_clean_tech(entities)} AS content FROM art),
    {sql_entities(source='clean')},
    pol AS (SELECT doc_id, title_clean.pol AS t, description_clean.pol AS d
        FROM title_clean JOIN description_clean USING (doc_id)),
    pairs AS ({pairs})
    SELECT "Entity", "Entity_Type", min(doc_id) AS sample_doc_id, {', '.join(stats)}
    FROM pairs JOIN pol USING (doc_id) GROUP BY "Entity", "Entity_Type\""""


@query(entity_polarity_sql("""SELECT a.doc_id, a.text AS "Entity", b.label AS "Entity_Type"
    FROM men a JOIN men b ON a.doc_id = b.doc_id"""))
def entity_polarity_cross(spark, sf):
    return _entity_polarity(spark, sf, "cross")


@query(entity_polarity_sql('SELECT doc_id, text AS "Entity", label AS "Entity_Type" FROM men'))
def entity_polarity_zip(spark, sf):
    return _entity_polarity(spark, sf, "zip")
