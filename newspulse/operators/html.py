"""From raw pages to article rows and story links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.functions import html as H
from newspulse.functions import text as X
from newspulse.functions.rows import posexploded
from newspulse.resources.sites import SITES, Site


def page_articles(pages: DataFrame, body: str = "article", title: str = "h1") -> DataFrame:
    """Article columns for pages whose body region is flat; pages lacking body or headline drop out.

    All fields stay on the page's own row, so a skipped page can never shift the links of the others.
    """
    return (
        pages.withColumnRenamed("url", "link")
        .withColumn("_title", H.first_element(F.col("html"), title))
        .withColumn("_body", H.first_element(F.col("html"), body))
        .where(F.col("_title").isNotNull() & F.col("_body").isNotNull())
        .withColumn("title", X.squeeze(H.markup_text(F.col("_title"))))
        .withColumn("content", X.squeeze(H.markup_text(F.col("_body"))))
        .withColumn("medie", F.parse_url("link", F.lit("HOST")))
        .drop("html", "_title", "_body")
    )


def story_links(
    html: Column,
    container: str,
    attr: str,
    prefix: Column | str = "",
    container_class: str | None = None,
    need_attr: str | None = None,
    unwanted_value: str | None = None,
) -> Column:
    """Array of links: for each container the attribute of its first anchor, made absolute.

    With ``need_attr`` only containers that carry the attribute, with another value than
    ``unwanted_value``, count.
    """
    boxes = F.regexp_extract_all(html, F.lit(H.container_pattern(container, container_class)), F.lit(0))
    if need_attr:
        boxes = F.filter(boxes, lambda b: H.attribute(b, container, need_attr) != F.lit(unwanted_value))
    lead = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.transform(boxes, lambda b: F.concat(lead, H.attribute(b, "a", attr)))


def explode_links(pages: DataFrame, links: Column, skip: Column | int = 0) -> DataFrame:
    """One row per link of a page; ``skip`` drops the first ones (live items)."""
    keep = [c for c in pages.columns if c != "html"]
    first = F.lit(skip) if isinstance(skip, int) else skip
    marked = pages.withColumn("_skip", first)
    return (
        posexploded(marked, [*keep, "_skip"], links, "link").where(F.col("pos") >= F.col("_skip")).drop("_skip")
    )


def site_links(pages: DataFrame, sites: tuple[Site, ...] = SITES) -> DataFrame:
    """Story links of front pages, one pass whatever the number of outlets (column ``medie``)."""
    links, skip = F.lit(None).cast("array<string>"), F.lit(0)
    for s in sites:
        here = F.col("medie") == s.medie
        found = story_links(
            F.col("html"), s.link_tag, s.link_attr, s.link_prefix, s.link_class, s.need_attr, s.unwanted_value
        )
        links = F.when(here, found).otherwise(links)
        skip = F.when(here, F.lit(s.skip_links)).otherwise(skip)
    return explode_links(pages, links, skip)


def zip_lists(pages: DataFrame, *lists: tuple[str, Column]) -> DataFrame:
    """Line up several element lists of one page by position; shorter lists are padded with null."""
    keep = [c for c in pages.columns if c != "html"]
    named = pages.select(*keep, *[col.alias(name) for name, col in lists])
    zipped = F.arrays_zip(*[F.col(name) for name, _ in lists])
    return posexploded(named, keep, zipped, "_z").select(*keep, "pos", "_z.*")


def listed_articles(pages: DataFrame, site: Site) -> DataFrame:
    """(medie, link, title, content) of an outlet whose front page holds its short articles in full.

    Links, headlines and bodies are three lists of the page, lined up by position.
    """
    html = F.col("html")
    zipped = zip_lists(
        pages.where(F.col("medie") == site.medie).select("medie", "html"),
        ("link", story_links(html, site.link_tag, site.link_attr, site.link_prefix, site.link_class)),
        ("title", H.all_texts(html, site.title_tag, site.title_class)),
        ("content", H.all_texts(html, site.body_tag, site.body_class)),
    )
    return zipped.drop("pos")


def nested_regions(pages: DataFrame, sites: tuple[Site, ...] = SITES) -> DataFrame:
    """``title`` and ``content`` of article pages whose body region contains nested elements.

    Pages of an unknown outlet, and pages lacking body or headline, drop out.
    """
    keep = [c for c in pages.columns if c != "html"]
    title = content = F.lit(None).cast("string")
    for s in sites:
        here = F.col("medie") == s.medie
        title = F.when(here, H.nested_text(F.col("html"), s.title_tag, s.title_class)).otherwise(title)
        content = F.when(here, H.nested_text(F.col("html"), s.body_tag, s.body_class)).otherwise(content)
    rows = pages.select(*keep, title.alias("_title"), content.alias("_content"))
    rows = rows.where(F.col("_title").isNotNull() & F.col("_content").isNotNull())
    return rows.select(*keep, X.squeeze("_title").alias("title"), X.squeeze("_content").alias("content"))
