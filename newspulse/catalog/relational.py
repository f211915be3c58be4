"""Filters, labels, links, unions, duplicates, rankings and reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from newspulse import schemas as S
from newspulse.catalog.base import articles, documents, lit, pages, query, table
from newspulse.functions import columns as C
from newspulse.operators import dedup, filters, geometry, numbering, reports
from newspulse.session import stage_path
from newspulse.sources import readers, variants, writers
from newspulse.sources import stored as keyed_tables
from newspulse.streaming import daily, state

# Topic families matched to the words of the test documents. The first two reuse the shape of the
# real ones: an exclusion with an exception.
FAMILIES = {
    "drop": [r"\b(apache|gnu|mit)\s+(general public )?license\b", r"\b(all rights reserved)\b"],
    "drop_unless_allowed": [r"\b(trash|idiots?|stupid(?!-?ly)|moron)\b"],
    "allow": [r"\b(free|thon|einheit)\b", r"\berin[-\s]?the\b"],
    "include": [r"\b(thon(s)?|anea)\b", r"\b(of\s*the|to\s*the)\b", r"\b(de\s*la)\b", r"\b(und|oder)\s*die\b"],
}
CLASSES = {"THE": [r"\bthe\b", r"\bthat?s\b"], "AND": [r"\band\b", r"\bunds?\b", r"\bet\b"]}

EDGE = r"[^\p{L}\p{N}_]"


def _any(*alternatives: str) -> str:
    """Word-bounded alternatives without look-around, for the SQL engine."""
    return lit(f"(^|{EDGE})({'|'.join(alternatives)})({EDGE}|$)")


LOWER = "lower(text)"


@query(f"""SELECT doc_id FROM documents
    WHERE NOT (regexp_matches({LOWER}, {_any('(apache|gnu|mit)[ \n]+(general public )?license', 'all rights reserved')})
        OR (regexp_matches(replace(replace({LOWER}, 'stupid-ly', ''), 'stupidly', ''), {_any('trash|idiots?|stupid|moron')})
            AND NOT regexp_matches({LOWER}, {_any('free|thon|einheit', '(erin)[- \n]?the')})))
      AND regexp_matches({LOWER}, {_any('thons?|anea', '(of|to)[ \n]*the', 'de[ \n]*la', '(und|oder)[ \n]*die')})""")
def topic_filter(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.col("text").alias("summary"))
    return filters.topical(rows, FAMILIES).select("doc_id")


@query(f"""WITH t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS t FROM documents),
    f AS (SELECT doc_id, regexp_matches(t, {_any('the', 'that?s')}) AS a, regexp_matches(t, {_any('and', 'unds?', 'et')}) AS b FROM t)
    SELECT doc_id, CASE WHEN a AND b THEN 'Both' WHEN a THEN 'THE' WHEN b THEN 'AND' ELSE 'Other' END AS currency_topic FROM f""")
def currency_class(spark, sf):
    return articles(spark, sf).select("doc_id", filters.two_way_class("title", CLASSES).alias("currency_topic"))


@query("SELECT conv_id, turn, len(text) AS n_chars FROM conversations WHERE len(text) > 1")
def nonempty(spark, sf):
    rows = filters.with_text(table(spark, sf, "conversations"), "text")
    return rows.select("conv_id", "turn", F.length("text").alias("n_chars"))


@query("SELECT doc_id, source, lang, n_chars FROM documents")
def simple_projection(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")


TITLE = "CASE event_type WHEN 'error' THEN '[Removed]' WHEN 'view' THEN NULL ELSE event_type END"


def _event_titles(spark, sf):
    """Events with a title: a placeholder for errors, none for views."""
    kind = F.col("event_type")
    title = F.when(kind == "error", "[Removed]").when(kind != "view", kind)
    return table(spark, sf, "events").withColumn("title", title)


@query(f"SELECT event_id, title FROM (SELECT event_id, {TITLE} AS title FROM events) WHERE title IS DISTINCT FROM '[Removed]'")
def drop_placeholder(spark, sf):
    return filters.drop_placeholder(_event_titles(spark, sf)).select("event_id", "title")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3', 'src7', 'src11')")
def source_isin(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return filters.from_sources(rows, ["src0", "src3", "src7", "src11"], "source")


@query("""SELECT event_id, CASE WHEN x < 0 THEN 'negative' WHEN x = 0 THEN 'neutral' ELSE 'positive' END AS label
    FROM (SELECT event_id, floor(value) - 20 AS x FROM events)""")
def polarity_label(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.polarity_label(F.floor("value") - 20).alias("label")
    )


@query("""SELECT event_id, CASE WHEN x >= 0.05 THEN 'positive' WHEN x <= -0.05 THEN 'negative' ELSE 'neutral' END AS label
    FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN (floor(value) - 20) / 100.0::DOUBLE END AS x FROM events)""")
def compound_label(spark, sf):
    score = F.when(F.col("event_type") != "error", (F.floor("value") - 20) / F.lit(100.0))
    return table(spark, sf, "events").select("event_id", C.compound_label(score).alias("label"))


@query("""SELECT 'doc/' || doc_id AS url, source AS source_id, upper(source) AS source_name,
    split_part(text, chr(10), 1) AS title, text AS content FROM documents""")
def json_articles_flatten(spark, sf):
    """Documents written as news documents, one per line, and flattened back."""
    folder = stage_path(spark, "news-json")
    source = F.struct(F.col("medie").alias("id"), F.upper("medie").alias("name"))
    record = F.struct(source.alias("source"), "title", F.concat(F.lit("doc/"), "doc_id").alias("url"), "content")
    articles(spark, sf).select(F.lit("ok").alias("status"), F.array(record).alias("articles")).write.json(folder)
    flat = readers.json_articles(spark, folder, multi_line=False)
    return flat.select("url", "source_id", "source_name", "title", "content")


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _event_props(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "event_type", F.from_json("props", "k long").alias("p")
    ).select("event_id", "event_type", F.col("p.k").alias("k"))


@query(f"SELECT event_id, event_type, {K} AS k FROM events")
def json_props(spark, sf):
    return _event_props(spark, sf)


@query(f"""SELECT event_id, '$["' || key || '"]' AS path,
        CASE WHEN json_type(props, '$.' || key) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE json_type(props, '$.' || key) END AS kind,
        json_extract_string(props, '$.' || key) AS value
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def variant_leaves(spark, sf):
    """Every value of a JSON column of unknown shape, with its path."""
    docs = variants.parsed(table(spark, sf, "events").select("event_id", "props"), "props")
    return variants.leaves(docs, ["event_id"], "doc")


# What a feed might send for each event: a list with keys that no schema declares, a message without a list, or
# a document that was cut off.
FEED_DOCUMENT = """CASE WHEN event_id % 11 = 3 THEN '{"feed": [{"title": "' || event_type
    WHEN event_id % 13 = 5 THEN '{"Information": "limit of user ' || user_id || '"}'
    ELSE '{"items": 1, "feed": [{"title": "' || event_type || '", "url": "u/' || event_id || '", "props": ' || props
        || ', "topics": [{"topic": "t' || event_id % 5 || '", "relevance": ' || event_id % 7 || '}, {"topic": "all"}]},'
        || ' {"title": 7, "url": "v/' || event_id || '"}]}' END"""


@query(f"""WITH sound AS (SELECT * FROM events WHERE event_id % 11 <> 3 AND event_id % 13 <> 5)
    SELECT event_id, 0 AS pos, event_type AS title, 'u/' || event_id AS url, {K} AS k,
        't' || event_id % 5 || ',all' AS topics, event_id % 7 AS relevance FROM sound
    UNION ALL SELECT event_id, 1, '7', 'v/' || event_id, NULL, NULL, NULL FROM sound""")
def feed_variant(spark, sf):
    """Feed items with declared columns, and keys that nobody declared at two depths."""
    documents = variants.parsed(table(spark, sf, "events").select("event_id", F.expr(FEED_DOCUMENT).alias("raw")))
    rows = variants.items(documents, "feed", S.FEED_ITEM)
    topics = F.try_variant_get("rest", "$.topics", "array<struct<topic:string>>")
    return rows.select(
        "event_id", "pos", "title", "url", F.try_variant_get("rest", "$.props.k", "bigint").alias("k"),
        F.array_join(F.transform(topics, lambda t: t["topic"]), ",").alias("topics"),
        F.try_variant_get("rest", "$.topics[0].relevance", "bigint").alias("relevance"))


@query("""SELECT event_id, event_id % 11 <> 3 AS valid, event_id % 11 <> 3 AND event_id % 13 <> 5 AS has_list,
    CASE WHEN event_id % 11 <> 3 AND event_id % 13 = 5 THEN 'limit of user ' || user_id END AS message FROM events""")
def feed_status(spark, sf):
    """Which documents of a feed are broken or hold a message instead of their list."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("file_name"), F.expr(FEED_DOCUMENT).alias("raw"))
    return variants.status(variants.parsed(rows), "feed", "Information", "Note").withColumnRenamed("file_name", "event_id")


@query(f"SELECT event_id, {K} AS k FROM events WHERE {K} IS NOT NULL AND {K} <> 42")
def attr_filter(spark, sf):
    return filters.has_attribute(_event_props(spark, sf), F.col("k"), 42).select("event_id", "k")


@query("""SELECT page_id, array_to_string(s, '/') AS categories, s[1] AS category_1, s[2] AS category_2
    FROM (SELECT page_id, list_filter(string_split(url, '/')[4:-2], lambda x: x <> '') AS s FROM pages)""")
def url_category(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.array_join(C.link_segments("url"), "/").alias("categories"),
        C.link_category("url", 0).alias("category_1"), C.link_category("url", 1).alias("category_2"),
    )


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS published_s FROM events")
def parse_ts(spark, sf):
    stamped = table(spark, sf, "events").withColumn("publishedAt", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return stamped.select("event_id", F.unix_timestamp(C.iso_timestamp("publishedAt")).alias("published_s"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN NULL
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published FROM events""")
def parse_ts_coerce(spark, sf):
    compact = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), compact)).when(
        F.col("event_type") != "view", compact
    )
    stamped = table(spark, sf, "events").withColumn("time_published", broken)
    return stamped.select(
        "event_id", F.date_format(C.compact_timestamp("time_published"), "yyyy-MM-dd HH:mm:ss").alias("published")
    )


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS churn,
    CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS churn_date FROM orders""")
def churn_cleanup(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("churn"), F.col("o_orderdate").cast("date").alias("churn_date")
    )
    cleaned = rows.withColumn("churn_date", C.keep_when("churn", "churn_date"))
    return cleaned.withColumn("churn_date", F.date_format("churn_date", "yyyy-MM-dd"))


@query("""SELECT o_orderkey, CAST(2023 - year(o_orderdate)
        - CASE WHEN (2, 28) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END AS INTEGER) AS age FROM orders""")
def age_years(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", C.age_years("o_orderdate", F.lit(date(2023, 2, 28))).alias("age")
    )


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS "W", p_retailprice AS "D", v.x AS "X", v.y AS "Y", v.o AS "Order"
    FROM (SELECT *, unnest([{'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'o': 1}, {'x': 0.0::DOUBLE, 'y': p_retailprice, 'o': 2},
        {'x': p_size::DOUBLE, 'y': p_retailprice, 'o': 3}, {'x': p_size::DOUBLE, 'y': 0.0::DOUBLE, 'o': 4}]) AS v FROM part)
    ORDER BY p_partkey, "Order\"""")
def rect_polygon(spark, sf):
    rectangles = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("W"), F.col("p_retailprice").alias("D")
    )
    return geometry.rectangle_vertices(rectangles).orderBy("p_partkey", "Order")


@query("""SELECT link, title, content, medie FROM (
    SELECT url AS link, NULL AS title, html AS content, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS medie FROM pages
    UNION ALL SELECT NULL, split_part(text, chr(10), 1), text, source FROM documents
    UNION ALL SELECT NULL, NULL, text, 'chat/' || role FROM conversations)""")
def union_media(spark, sf):
    web = table(spark, sf, "pages").select(
        F.col("url").alias("link"), F.col("html").alias("content"), F.parse_url("url", F.lit("HOST")).alias("medie")
    )
    written = articles(spark, sf).select("title", "content", "medie")
    chat = table(spark, sf, "conversations").select(
        F.col("text").alias("content"), F.concat(F.lit("chat/"), "role").alias("medie")
    )
    return dedup.union_all(web, written, chat).select("link", "title", "content", "medie")


DEDUP_SQL = """WITH k AS (SELECT page_id, url,
        CASE WHEN url NOT LIKE '%#top' THEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS link FROM pages)
    SELECT link, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id) AS r FROM k) WHERE r = 1"""


def _keyed_pages(pages_table):
    """Pages with a repeating link (the host) that is sometimes missing."""
    host = F.when(~F.col("url").endswith("#top"), F.parse_url("url", F.lit("HOST")))
    return pages_table.select(host.alias("link"), "page_id", "url")


@query(DEDUP_SQL)
def dedup_link(spark, sf):
    return dedup.first_per_key(_keyed_pages(table(spark, sf, "pages")), ["link"], ["page_id"])


@query(DEDUP_SQL)
def stream_dedup(spark, sf):
    """The same rows when the pages arrive as a stream and are appended to a stored table."""
    kind = table(spark, sf, "pages").schema
    stream = spark.readStream.schema(kind).parquet(f"{sf.rstrip('/')}/pages.parque[t]")
    stored, mark = stage_path(spark, "stream-table"), stage_path(spark, "stream-offsets")
    daily.run_available(_keyed_pages(stream), stored, mark, order=("page_id",)).awaitTermination()
    return spark.read.parquet(stored)


@query(DEDUP_SQL)
def stream_state(spark, sf):
    """The same rows again, from a stream that remembers its keys in a state store and never reads the table."""
    kind = table(spark, sf, "pages").schema
    stream = spark.readStream.schema(kind).parquet(f"{sf.rstrip('/')}/pages.parque[t]")
    stored, mark = stage_path(spark, "state-table"), stage_path(spark, "state-offsets")
    state.run_available(_keyed_pages(stream), stored, mark, "link", ("page_id",)).awaitTermination()
    return spark.read.schema(_keyed_pages(table(spark, sf, "pages")).schema).parquet(stored)


@query("""WITH o AS (SELECT o_custkey AS k, min(o_orderkey) AS first_id FROM orders GROUP BY ALL),
    e AS (SELECT user_id AS k, min(event_id) AS first_id FROM events GROUP BY ALL)
    SELECT k, first_id, 'order' AS kind FROM o
    UNION ALL SELECT k, first_id, 'event' FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k IS NOT DISTINCT FROM e.k)""")
def store_append(spark, sf):
    """Two batches appended to a table stored by key: only files that may hold a key of the second are read."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("long").alias("k"), F.col("o_orderkey").cast("long").alias("first_id"), F.lit("order").alias("kind"))
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("long").alias("k"), F.col("event_id").cast("long").alias("first_id"), F.lit("event").alias("kind"))
    path = stage_path(spark, "store")
    name = "store_" + path[-32:]
    keyed_tables.create_store(spark, name, orders.schema, "k", path)
    for batch in (orders, events):
        keyed_tables.append_unseen(batch, name, ["first_id"])
    return spark.table(name).drop(keyed_tables.SLICE)


@query("""SELECT 'doc/' || doc_id AS link, split_part(text, chr(10), 1) AS title, text AS content, source AS medie
    FROM documents""")
def scan_daily_csv(spark, sf):
    """Documents written as CSV files, one folder scan to read them back."""
    folder = stage_path(spark, "daily-csv")
    rows = articles(spark, sf).withColumn("link", F.concat(F.lit("doc/"), "doc_id"))
    writers.csv_export(rows.select("link", "title", "content", "medie"), folder)
    return readers.daily_articles(spark, folder).drop("Filename", "row_id")


@query(f"""SELECT DISTINCT user_id, title FROM (
    SELECT user_id, {TITLE} AS title FROM events UNION ALL SELECT o_custkey, o_orderstatus FROM orders)
    WHERE title IS DISTINCT FROM '[Removed]'""")
def append_distinct(spark, sf):
    existing = _event_titles(spark, sf).select("user_id", "title")
    new = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("title")
    )
    return dedup.merge_distinct(existing, new)


@query("""WITH j AS (SELECT d.doc_id, text, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
    SELECT * FROM (VALUES
    ('doc_id', 'bigint', (SELECT count(doc_id) FROM j)), ('text', 'string', (SELECT count(text) FROM j)),
    ('lang', 'string', (SELECT count(lang) FROM j)), ('source', 'string', (SELECT count(source) FROM j)),
    ('n_chars', 'bigint', (SELECT count(n_chars) FROM j)), ('quality', 'int', (SELECT count(quality) FROM j)),
    ('toxic', 'int', (SELECT count(toxic) FROM j))) AS t("column", dtype, non_null)""")
def null_profile(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return reports.null_profile(joined)


@query("SELECT source AS medie, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, medie")
def media_counts(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("medie"))
    return reports.value_counts(rows, "medie")


@query("""SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
    ORDER BY c_custkey, o_orderkey""")
def join_sorted(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    return joined.orderBy("c_custkey", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def top1_per_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedup.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1)


@query("""SELECT event_id, event_type, value, (r - 1) // 20 + 1 AS page FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events
        WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21')
    WHERE r <= 60""")
def paged_window(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    sources = table(spark, sf, "events").where(F.col("event_type") != "error").select("event_type").distinct()
    pulled = readers.landed_articles(
        events, sources, date(2024, 1, 3), date(2024, 1, 20), pages=3, page_size=20,
        source="event_type", popularity="value", tie="event_id", ts="ts",
    )
    return pulled.select("event_id", "event_type", "value", "page")


@query("""SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-01'
    ORDER BY ts DESC, event_id LIMIT 1000""")
def feed_latest(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    return readers.latest_feed(events, "ts", "event_id", date(2025, 6, 30)).select("event_id", "event_type", "value")


@query("""SELECT event_type, event_id, value FROM events WHERE event_type IN ('click', 'purchase')
    ORDER BY event_type, ts, event_id""")
def topic_series(spark, sf):
    events = table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    return reports.series(events, "event_type", ["click", "purchase"], "ts", "event_id").drop("ts")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 20")
def head20(spark, sf):
    return reports.head(table(spark, sf, "documents"), ["doc_id", "lang", "n_chars"], ["doc_id"])


POSITIONAL_SQL = """WITH c AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position, c_custkey FROM customer),
    s AS (SELECT row_number() OVER (ORDER BY s_name) - 1 AS position, s_suppkey, s_name FROM supplier)
    SELECT position, c_custkey, s_suppkey, s_name FROM c {} JOIN s USING (position)"""


def _side_by_side(spark, sf, how):
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    order = [F.desc("c_acctbal"), F.asc("c_custkey")]
    return numbering.positional_join(customers, suppliers, order, [F.asc("s_name")], how).drop("c_acctbal")


@query(POSITIONAL_SQL.format(""))
def positional_inner(spark, sf):
    return _side_by_side(spark, sf, "inner")


@query(POSITIONAL_SQL.format("FULL"))
def positional_outer(spark, sf):
    return _side_by_side(spark, sf, "outer")
