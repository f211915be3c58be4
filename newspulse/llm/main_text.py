"""Main text of HTML pages: markup says what a block is for, and a suffix array of the host what is boilerplate.

Each page becomes blocks of text, those of menus, headers, footers, forms and the like left out, those inside the
article marked. The word streams of different pages of a host are concatenated and sorted by their suffixes, to the
depth of the shortest passage that counts as long. The sorting is done in groups of pages, the pages of a passage
are summed over the groups, so one verdict holds on all pages of the host. Passages that many pages share are
boilerplate: the words that they cover are removed wherever they stand, all others are kept.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse.llm.common import ref, small_batches, text_udf
from newspulse.session import stage

DEPTH = 8  # words of a passage that counts as long
GROUP = 256  # pages of one host sorted together
NAME = 32  # hexadecimal digits of the name of a passage

READ = T.StructType([
    T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("main", T.BooleanType()), T.StructField("page", T.StringType()),
])
PACKED = T.StructType([T.StructField("blocks", T.BinaryType())])
TEXT = T.StructType([T.StructField("text", T.StringType())])
PASSAGES = "host string, passage string, pages long"

# Elements whose content is no text of the page, and elements that are not its main text.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "title", "xmp")
ASIDE = (
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "label", "datalist",
    "audio", "video",
)
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "img", "wbr", "input",
)
MAIN = ("article", "main")
# Roles, and words that a name in a class or id starts with, of parts that are not the main text.
ASIDE_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu")
ASIDE_NAMES = re.compile(
    r"(?:(?:site|page|main|global|primary|secondary|top|bottom|left|right|mobile)[_-]+)?(?:ads?|advert\w*|adsense|sponsor\w*|"
    r"promo\w*|banner|nav(?!y)\w*|menu\w*|breadcrumbs?|sidebar|side|footer|masthead|header|cookies?\w*|consent|gdpr|notice|"
    r"notification|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|widget|toolbar|skip-?link|"
    r"pagination|pager)(?=$|[_-])", re.I)
# Parts with articles and long texts of their own.
OTHER_TEXTS = re.compile(
    r"(?:(?:post|entry|article|page)[_-]+)?(?:comments?|commentlist|disqus|replies|respond|related|recommended)(?=$|[_-])", re.I)
# What shows that an aside is a wrapper of the page instead: it holds the main element, the article, most of the text.
BY_MAIN, BY_ARTICLE, BY_SIZE = 1, 2, 4
WRAPPERS = {"form": BY_MAIN | BY_ARTICLE | BY_SIZE, "fieldset": BY_MAIN | BY_ARTICLE | BY_SIZE, "header": BY_MAIN | BY_ARTICLE}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|"
    r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
BODY_TAGS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}


@dataclass
class Block:
    text: str
    main: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    has_main: bool = False


def aside(tag: str, attributes: str, in_main: bool) -> int:
    """Zero for a part of the text; else ``BY_`` flags: what inside would show that the element is a wrapper."""
    if tag in ASIDE and not (tag in ("header", "label") and in_main):
        return WRAPPERS.get(tag, BY_MAIN)
    flags = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NOT_SHOWN.search(value):
            flags = flags or BY_MAIN | BY_ARTICLE | BY_SIZE
        elif name == "role" and value.lower() in ASIDE_ROLES:
            return WRAPPERS.get(value.lower(), BY_MAIN)
        elif name in ("class", "id") and tag not in ("html", "body", *MAIN):
            for word in value.split():
                if OTHER_TEXTS.match(word):
                    return BY_MAIN
                if ASIDE_NAMES.match(word):
                    flags = BY_MAIN | BY_ARTICLE | BY_SIZE
    return flags


@dataclass
class Elements:
    """The elements of a page in order, by number; 0 is the page itself. ``size`` counts characters outside links."""

    parent: list[int] = field(default_factory=lambda: [0])
    aside: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])  # article or main, or empty
    in_main: list[bool] = field(default_factory=lambda: [False])
    in_aside: list[bool] = field(default_factory=lambda: [False])
    size: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, flags: int, tag: str) -> int:
        self.parent.append(parent)
        self.aside.append(flags)
        self.tag.append(tag)
        self.in_main.append(self.in_main[parent] or tag != "")
        self.in_aside.append(self.in_aside[parent] or flags > 0)
        self.size.append(0)
        return len(self.parent) - 1

    def settle(self) -> None:
        """Take wrappers out of the asides.

        An aside is a wrapper if it holds a main element. Where no article stands outside the asides, it is one too
        if it holds an article and no less text than there is outside, or more than half of the text of the page;
        inside an article, it is one by more than half of the text.
        """
        if not any(self.aside):
            return
        free = sum(n for n, off in zip(self.size, self.in_aside) if not off)
        found = any(t and not off for t, off in zip(self.tag, self.in_aside))
        size, holds = self.size[:], [0] * len(self.size)
        for i in range(len(size) - 1, 0, -1):
            up = self.parent[i]
            size[up] += size[i]
            holds[up] |= holds[i] | {"": 0, "main": BY_MAIN, "article": BY_ARTICLE}[self.tag[i]]
        for i in range(1, len(size)):
            flags, up = self.aside[i], self.parent[i]
            wrapper = flags & holds[i] & BY_MAIN or not found and flags & holds[i] & BY_ARTICLE and size[i] >= free or (
                flags & BY_SIZE and (not found or self.in_main[up]) and 2 * size[i] > size[0])
            self.in_aside[i] = self.in_aside[up] or flags > 0 and not wrapper


def read_page(markup: str | None) -> Page:
    """Blocks of a page in order, without the parts that are not main text; unclosed elements end with their parent."""
    source = markup or ""
    parts: list[tuple[str, int]] = []
    blocks: list[tuple[list[tuple[str, int]], int]] = []
    open_tags: list[tuple[str, int]] = [("", 0)]
    elements = Elements()
    at = links = 0

    def close_block() -> None:
        nonlocal parts
        if parts:
            blocks.append((parts, open_tags[-1][1]))
            parts = []

    def add(text: str) -> None:
        inside = open_tags[-1][1]
        parts.append((text, inside))
        if not links:
            elements.size[inside] += len(text.strip())

    def pop() -> None:
        nonlocal links
        links -= open_tags.pop()[0] == "a"

    while at < len(source):
        m = TAG.search(source, at)
        end = m.start() if m else len(source)
        if end > at:
            add(source[at:end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:-3]))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag not in INLINE:
            close_block()
        if closing:
            if any(name == tag for name, _ in open_tags):
                while open_tags[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            stop = ENDS[tag].search(source, at)
            at = stop.end() if stop else len(source)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in ("p", "div"):
            continue
        while open_tags[-1][0] in BODY_TAGS.get(tag, ()):
            pop()
        parent = open_tags[-1][1]
        role_main = tag not in MAIN and re.search(r"\brole\s*=\s*[\"']?main\b", m[3], re.I)
        is_main = "main" if role_main else tag if tag in MAIN else ""
        open_tags.append((tag, elements.add(parent, aside(tag, m[3], elements.in_main[parent]), is_main)))
        links += tag == "a"
    close_block()
    elements.settle()
    page = Page(has_main=any(t and not off for t, off in zip(elements.tag, elements.in_aside)))
    for pieces, inside in blocks:
        text = SPACE.sub(" ", html.unescape("".join(t for t, i in pieces if not elements.in_aside[i]))).strip()
        if text:
            page.blocks.append(Block(text, elements.in_main[inside]))
    return page


def shared_passages(streams: list[list[np.ndarray]], depth: int = DEPTH, least: int = 2) -> list[tuple[int, int, int, int, int]]:
    """Passages of ``depth`` words that stand on at least ``least`` pages: page, block, first word and number of words
    of one occurrence, and the number of pages.

    A suffix array of the concatenated streams, sorted by doubling to ``depth`` words: suffixes that agree so far
    are neighbours. A block shorter than that is a passage of its own, between its ends. Word names start at 1; 0
    stands between blocks.
    """
    flat, page, block, pad = [], [], [], np.zeros(1, np.int64)
    for i, blocks in enumerate(streams):
        for j, b in enumerate(blocks):
            flat += [pad, b]
            page.append(np.full(len(b) + 1, i, np.int64))
            block.append(j)
    if not flat:
        return []
    words = np.concatenate([*flat, np.zeros(depth, np.int64)])
    owner = np.concatenate([*page, np.full(depth, -1, np.int64)])
    # A block end stops a passage: names behind it would tie short blocks to what follows them.
    ends = np.flatnonzero(words == 0)
    places = np.arange(len(words))
    until = ends[np.searchsorted(ends, places, "right").clip(max=len(ends) - 1)]
    rank, span = words, 1
    while span < depth:
        ahead = np.minimum(places + span, len(words) - 1)
        follow = np.where(places + span <= until, rank[ahead], 0)
        pair = rank * (int(rank.max()) + 2 + len(words)) + follow
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        rank[words == 0] = 0
        span *= 2
    starts_block = np.zeros(len(words), bool)
    starts_block[np.minimum(ends + 1, len(words) - 1)] = True
    whole = np.flatnonzero(((places + depth <= until) | starts_block) & (words > 0))
    # Pages of each passage, counted once.
    seen = np.unique(np.stack([rank[whole], owner[whole]]), axis=1)
    pages = np.bincount(seen[0], minlength=int(rank.max()) + 1)
    which, first = np.unique(rank[whole], return_index=True)
    at = whole[first[pages[which] >= least]]
    number = np.searchsorted(ends, at) - 1
    return [
        (int(owner[x]), block[b], int(x - ends[b] - 1), int(min(depth, until[x] - x)), int(pages[rank[x]]))
        for x, b in zip(at, number)
    ]


def passage_name(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def read_blocks(markup: str | None) -> tuple[list[str], bool, str]:
    """Texts of the blocks that count, all inside the article if there is one; whether there is; a name of the texts."""
    page = read_page(markup)
    blocks = [b.text for b in page.blocks if b.main or not page.has_main]
    return blocks, page.has_main, passage_name("\n".join(blocks))


def pack_blocks(blocks: list[str] | None) -> tuple[bytes]:
    """Blocks as they travel to their group: pages compressed one by one take a third less than in a shuffle of Spark."""
    return (zstandard.compress("\n".join(blocks or ()).encode("utf-8", "surrogatepass")),)


def unpack_blocks(packed: bytes) -> list[str]:
    return zstandard.decompress(packed).decode("utf-8", "surrogatepass").split("\n")


def passages_of(pages: list[list[str]], depth: int = DEPTH) -> list[tuple[str, int]]:
    """Names of the passages that several of the pages share, with the number of these pages."""
    names: dict[str, int] = {}
    words = [[b.split(" ") for b in blocks] for blocks in pages]
    streams = [[np.array([names.setdefault(w, len(names) + 1) for w in b], np.int64) for b in blocks] for blocks in words]
    return [
        (passage_name(" ".join(words[p][b][at:at + n])), pages_of)
        for p, b, at, n, pages_of in shared_passages(streams, depth)
    ]


@functools.lru_cache(maxsize=8)
def known_names(joined: str) -> frozenset[str]:
    return frozenset(joined[at:at + NAME] for at in range(0, len(joined), NAME))


def strip_passages(blocks: list[str], main: bool, known: frozenset[str], depth: int = DEPTH) -> list[str]:
    """The blocks without the words that known passages cover; blocks without any other words go.

    Of an article, blocks shorter than a passage stay: a heading or a short line may well be the same on many pages.
    An article of whose words more than half are covered is a copy of others and not their surroundings: it stays whole.
    """
    out, all_words, all_gone = [], 0, 0
    for block in blocks:
        words = block.split(" ")
        gone = np.zeros(len(words), bool)
        for at in range(0 if main and len(words) < depth else max(len(words) - depth, 0) + 1):
            if passage_name(" ".join(words[at:at + depth])) in known:
                gone[at:at + depth] = True
        all_words, all_gone = all_words + len(words), all_gone + int(gone.sum())
        if not gone.any():
            out.append(block)
        elif not gone.all():
            out.append(" ".join(w for w, g in zip(words, gone) if not g))
    return blocks if main and 2 * all_gone > all_words else out


def host_passages(read: DataFrame, group: int = GROUP) -> DataFrame:
    """Per host with boilerplate: ``most``, the joined names of the passages that go from articles, and ``some``, of
    those that go from pages without an article.

    ``read`` has host, row and b (``READ``). Counted are the different pages of a host, by their blocks: in articles
    a passage goes if at least four and more than half of them share it, elsewhere if at least three and a fifth
    do; so a host has at most ten times as many such passages as an average page has words. Different pages are
    dealt into groups at random by their names; a passage that only one page of a group holds is not reported by
    that group, so all that can be missed is a handful of pages of a passage near its limit.
    """
    texts = read.where(F.size("b.blocks") > 0).withColumn("page", F.col("b.page"))
    same = stage(texts.groupBy("host", "page").agg(F.count("*").alias("copies"), F.min("row").alias("first")), "pages")
    sizes = stage(same.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= 3), "hosts")
    again = stage(same.where(F.col("copies") > 1).select("host", "page", "first"), "copies")
    once = texts.join(again, ["host", "page"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("row")))
    dealt = once.join(sizes, "host").select(
        "host", F.pmod(F.xxhash64("page"), F.ceil(F.col("n") / group)).alias("part"),
        text_udf(lambda: pack_blocks, PACKED)(F.col("b.blocks"))["blocks"].alias("blocks"))

    def count(pages: pa.Table) -> pa.Table:
        found = passages_of([unpack_blocks(b.as_py()) for b in pages.column("blocks")])
        return pa.table({
            "host": pa.array([pages.column("host")[0].as_py()] * len(found), pa.string()),
            "passage": pa.array([name for name, _ in found], pa.string()), "pages": pa.array([n for _, n in found], pa.int64()),
        })

    found = dealt.groupBy("host", "part").applyInArrow(count, PASSAGES)
    totals = found.groupBy("host", "passage").agg(F.sum("pages").alias("pages")).join(sizes, "host")
    in_articles = F.col("pages") >= F.greatest(F.lit(4), F.floor(F.col("n") / 2) + 1)
    elsewhere = F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n") / 5))
    return stage(totals.where(elsewhere).groupBy("host").agg(
        F.array_join(F.collect_list(F.when(in_articles, F.col("passage"))), "").alias("most"),
        F.array_join(F.collect_list("passage"), "").alias("some")), "passages")


def main_text(pages: DataFrame, markup: str = "html", url: str = "url", key: str = "page_id", group: int = GROUP) -> DataFrame:
    """Key, url, main text and its number of characters of each row of ``pages``.

    References are decoded, white space inside a block is one space, blocks are joined by a line end; beside
    boilerplate (``host_passages``) nothing is cut. Null markup gives an empty text. Hosts come from the url (none:
    all such pages are one host). Keys never leave Spark, so any type and null will do. Repeated rows stay repeated
    and count as one page of their host; other columns are not read; an empty table gives an empty result. Pages
    are read once and their blocks staged; no host is gathered whole, and a page's verdict does not depend on the
    group it falls in.
    """
    small_batches()
    host = F.lower(F.coalesce(F.regexp_extract(ref(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(ref(key).alias("key"), ref(url).cast("string").alias("url"), ref(markup).cast("string").alias("html"), host.alias("host"))
    read = rows.select("key", "url", "host", text_udf(lambda: read_blocks, READ)(F.col("html")).alias("b"))
    read = stage(read.withColumn("row", F.monotonically_increasing_id()), "blocks", compression="zstd")

    def strip(page: dict | None) -> tuple[str | None]:
        if not page or not page["known"]:
            return (None,)
        return ("\n".join(strip_passages(page["blocks"], page["main"], known_names(page["known"]))),)

    joined = read.join(host_passages(read, group), "host", "left")
    known = F.when(F.col("b.main"), F.col("most")).otherwise(F.col("some"))
    page = F.when(known != "", F.struct(F.col("b.blocks").alias("blocks"), F.col("b.main").alias("main"), known.alias("known")))
    out = joined.select("key", "url", "b", text_udf(lambda: strip, TEXT)(page).alias("stripped"))
    text = F.coalesce(F.col("stripped.text"), F.array_join("b.blocks", "\n"))
    out = out.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
