"""Landed front pages and article pages to one article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newspulse.operators import html as O
from newspulse.operators.dedup import union_all
from newspulse.resources.sites import SITES, Site


def gather(
    front_pages: DataFrame, article_pages: DataFrame, sites: tuple[Site, ...] = SITES, listed: tuple[str, ...] = ("DR",)
) -> DataFrame:
    """(link, title, content, medie) from (medie, html) front pages and (url, html) article pages.

    Outlets in ``listed`` carry whole short articles on their front page; for the others the story links
    select the article pages, each read once even if several links lead to it.
    """
    linked = tuple(s for s in sites if s.medie not in listed)
    links = O.site_links(front_pages, linked).select("medie", "link").distinct()
    chosen = article_pages.select(F.col("url").alias("link"), "html").join(links, "link")
    parts = [O.nested_regions(chosen, linked)]
    parts += [O.listed_articles(front_pages, s) for s in sites if s.medie in listed]
    return union_all(*parts).select("link", "title", "content", "medie")
