"""Pages to articles and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from newspulse.catalog.base import (
    lit, pages, query, sql_decode, sql_markup_text, sql_squeeze,
)
from newspulse.functions import html as H
from newspulse.operators import html as O
from newspulse.resources.sites import Site
from newspulse.sources import readers

H1 = r"(?s)<h1(?:\s[^>]*)?>(.*?)</h1\s*>"
BODY = r"(?s)<article(?:\s[^>]*)?>(.*?)</article\s*>"
BOX = r"(?s)<li(?:\s[^>]*)?>.*?</li\s*>"
SITE = "^[a-z]+://[^/?#]+"

ARTICLE_SQL = f"""
    SELECT page_id, url AS link,
        {sql_squeeze(sql_markup_text(f"regexp_extract(html, {lit(H1)}, 1)"))} AS title,
        {sql_squeeze(sql_markup_text(f"regexp_extract(html, {lit(BODY)}, 1)"))} AS content,
        regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS medie
    FROM pages WHERE regexp_matches(html, {lit(H1)}) AND regexp_matches(html, {lit(BODY)})"""


@query(ARTICLE_SQL)
def html_article(spark, sf):
    return O.page_articles(pages(spark, sf)).select("page_id", "link", "title", "content", "medie")


def re_encoded(pages):
    """The pages in bytes as outlets serve them: UTF-8, UTF-16 of both orders with their mark, declared Latin-1."""
    kind, html = F.col("page_id") % 4, F.col("html")
    latin = F.replace(html, F.lit('charset="utf-8"'), F.lit("charset='ISO-8859-1'"))
    marked = lambda mark, order: F.concat(F.unhex(F.lit(mark)), F.encode(html, order))
    content = (
        F.when(kind == 1, marked("FFFE", "UTF-16LE")).when(kind == 2, marked("FEFF", "UTF-16BE"))
        .when((kind == 3) & ~html.rlike(r"[^\x00-\x7F\x{A0}-\x{FF}]") & latin.contains("ISO-8859-1"), F.encode(latin, "ISO-8859-1"))
        .otherwise(F.encode(html, "UTF-8"))
    )
    return pages.select("page_id", "url", content.alias("content"))


@query(ARTICLE_SQL)
def html_bytes(spark, sf):
    """Articles of pages that come as bytes in four encodings."""
    decoded = readers.decoded_pages(re_encoded(pages(spark, sf)))
    return O.page_articles(decoded).select("page_id", "link", "title", "content", "medie")


@query(f"SELECT page_id, {sql_markup_text(f'regexp_extract(html, {lit(H1)}, 1)')} AS title FROM pages")
def html_title(spark, sf):
    return pages(spark, sf).select("page_id", H.first_text(F.col("html"), "h1").alias("title"))


def _links(spark, sf, skip=0):
    site = F.regexp_extract("url", SITE, 0)
    links = O.story_links(F.col("html"), "li", "href", site)
    return O.explode_links(pages(spark, sf), links, skip).select("page_id", "pos", "link")


HREF = sql_decode(r"""regexp_extract(regexp_extract(box, '(?s)<a\s[^>]*>', 0), '\shref="([^"]*)"', 1)""")
LINKS_SQL = f"""
    SELECT page_id, pos, site || {HREF} AS link FROM (
        SELECT page_id, regexp_extract(url, '{SITE}', 0) AS site, unnest(b) AS box, unnest(range(len(b))) AS pos
        FROM (SELECT *, regexp_extract_all(html, {lit(BOX)}) AS b FROM pages))"""


@query(LINKS_SQL)
def html_links(spark, sf):
    return _links(spark, sf)


@query(f"SELECT * FROM ({LINKS_SQL}) WHERE pos > 0")
def html_links_tail(spark, sf):
    return _links(spark, sf, skip=1)


def _texts(tag):
    pattern = rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"
    return f"list_transform(regexp_extract_all(html, {lit(pattern)}, 1), lambda x: {sql_markup_text('x')})"


@query(f"""
    WITH l AS (SELECT page_id,
            list_transform(regexp_extract_all(html, {lit(BOX)}), lambda box: {HREF}) AS links,
            {_texts('a')} AS titles, {_texts('p')} AS contents FROM pages),
    n AS (SELECT *, greatest(len(links), len(titles), len(contents)) AS k FROM l)
    SELECT page_id, unnest(range(k)) AS pos,
        unnest(list_resize(links, k)) AS link, unnest(list_resize(titles, k)) AS title,
        unnest(list_resize(contents, k)) AS content
    FROM n""")
def zip_lists(spark, sf):
    html = F.col("html")
    return O.zip_lists(
        pages(spark, sf).select("page_id", "html"),
        ("link", O.story_links(html, "li", "href")),
        ("title", H.all_texts(html, "a")),
        ("content", H.all_texts(html, "p")),
    )


# Pages whose body nests in itself: the article as a box with boxes in it, and one more after it.
NESTED_SQL = """replace(replace(html, '<article>', '<div class="wide page__body"><DIV><div id="x"></div>'),
    '</article>', '</DIV><div class="more"> tail </div></div><div>after</div>')"""


@query(f"""WITH w AS (SELECT page_id, {NESTED_SQL} AS html FROM pages),
    p AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT page_id, regexp_extract_all(html,
        '(?s)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<[^>]*>|[^<]+') AS parts FROM w)),
    f AS (SELECT page_id, min(i) AS first FROM p WHERE part = '<div class="wide page__body">' GROUP BY page_id),
    d AS (SELECT page_id, i, part, sum(CASE WHEN regexp_matches(lower(part), '^<div[ >]') THEN 1 WHEN lower(part) = '</div>' THEN -1 ELSE 0 END)
        OVER (PARTITION BY page_id ORDER BY i) AS depth FROM p JOIN f USING (page_id) WHERE i >= first),
    e AS (SELECT page_id, min(i) AS last FROM d WHERE depth = 0 GROUP BY page_id)
    SELECT page_id, {sql_squeeze(sql_markup_text(f"regexp_extract(any_value(pages.html), {lit(H1)}, 1)"))} AS title,
        {sql_squeeze(sql_decode("string_agg(part, '' ORDER BY i) FILTER (part NOT LIKE '<%')"))} AS content
    FROM d JOIN e USING (page_id) JOIN pages USING (page_id) WHERE i < last GROUP BY page_id""")
def html_nested(spark, sf):
    """Headline and body of pages whose body region holds more elements of its own kind."""
    site = Site("all", "div", "page__body", "h1", None, "li", None, "href", "")
    rows = pages(spark, sf).select("page_id", F.lit("all").alias("medie"), F.expr(NESTED_SQL).alias("html"))
    return O.nested_regions(rows, (site,)).select("page_id", "title", "content")
