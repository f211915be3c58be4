"""Where each outlet keeps its headline, body and story links."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Site:
    """Selectors of one outlet. A class of ``None`` accepts the tag with any class."""

    medie: str
    body_tag: str
    body_class: str | None
    title_tag: str
    title_class: str | None
    link_tag: str
    link_class: str | None
    link_attr: str
    link_prefix: str
    skip_links: int = 0  # live items at the top of the front page
    need_attr: str | None = None  # containers must carry this attribute ...
    unwanted_value: str | None = None  # ... with any other value than this one


# The selectors have to equal the markup of the four front pages.
SITES = (
    Site("TV2", "div", "tc_page__body", "h1", None, "article", None, "href", "", skip_links=1),
    Site("BT", "div", "article-content", "h1", "article-title",
         "article", "teaser teaser--flat cat-news", "data-lpurl", "", skip_links=1),
    Site("DR", "article", "hydra-latest-news-page-short-news",
         "h2", "hydra-latest-news-page-short-news__title dre-variables",
         "div", "dre-teaser", "href", "https://dr.dk/"),
    Site("EB", "div", "article-bodytext", "h1", "art-title", "article", None, "href",
         "https://ekstrabladet.dk", need_attr="data-priority", unwanted_value="A+"),
)
