"""HTML extraction as column expressions, most of them for regions that do not nest in themselves.

Regions that do (a ``div`` inside the body ``div``) are found by ``nested_element``.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newspulse.functions.rows import let

# Named character references that occur in the test tables; the SQL twins decode these.
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£",
    "aelig": "æ", "oslash": "ø", "aring": "å", "AElig": "Æ", "Oslash": "Ø", "Aring": "Å",
    "eacute": "é", "egrave": "è", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß",
}


# Fixed value: the complete table of named references of the HTML standard, from the standard library.
REFERENCES = json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")})

# A tag, quoted attribute values with any signs in them; the plain form where quotes do not pair.
TAG = r"<(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[^>]*>"
IN_TAG = r"(?:[^>\"'\s]++|\s|\"[^\"]*+\"|'[^']*+')*"


def element_pattern(tag: str, cls: str | None = None) -> str:
    """Java pattern of an element's opening tag, in any case; ``cls`` may be one class or the whole attribute."""
    if cls is None:
        return rf"<(?i:{tag})(?:\s{IN_TAG})?>"
    name = re.escape(cls)
    value = rf"""(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}(?=[\s>]))"""
    return rf"<(?i:{tag})\s(?:{IN_TAG}\s)?(?i:class)\s*=\s*{value}{IN_TAG}>"


def _reference(part: Column) -> Column:
    """``&#233;rest`` → ``érest``, ``&#xe9;`` and ``&eacute;`` likewise; unknown names stay as they are.

    A number that is no character becomes the replacement character, as in browsers.
    """
    decimal = F.regexp_extract(part, "^&#([0-9]+);", 1)
    hexadecimal = F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]+);", 1)
    name = F.regexp_extract(part, "^&([A-Za-z][A-Za-z0-9]*);", 1)
    digits = F.when(hexadecimal != "", F.conv(F.right(hexadecimal, F.lit(12)), 16, 10)).otherwise(F.right(decimal, F.lit(12)))
    rest = F.regexp_replace(part, "^&[^;]*;", "")

    def numbered(code: Column) -> Column:
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        safe = F.when(valid, code).otherwise(F.lit(0xFFFD))
        return F.concat(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"), rest)

    known = F.try_element_at(F.from_json(F.lit(REFERENCES), "map<string,string>"), name)
    return (
        F.when((decimal != "") | (hexadecimal != ""), let(digits.cast("long"), numbered))
        .when(name != "", F.coalesce(F.concat(known, rest), part)).otherwise(part)
    )


def _decoded(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "(?=&)"), _reference), "")


def decode_entities(c: Column) -> Column:
    """Decode character references; rows without an ampersand skip the work."""
    return let(c, lambda x: F.when(x.contains("&"), _decoded(x)).otherwise(x))


def markup_text(c: Column) -> Column:
    """Text of a markup fragment: comments, scripts and styles dropped, text pieces joined directly."""
    out = F.regexp_replace(c, r"(?si)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    return decode_entities(F.regexp_replace(out, TAG, ""))


def first_element(html: Column, tag: str, cls: str | None = None) -> Column:
    """Markup of the first such element, its own tags included; null when the page has none."""
    return F.nullif(F.regexp_extract(html, container_pattern(tag, cls), 0), F.lit(""))


def first_text(html: Column, tag: str, cls: str | None = None) -> Column:
    return markup_text(first_element(html, tag, cls))


def all_texts(html: Column, tag: str, cls: str | None = None) -> Column:
    """Texts of all such elements, in page order."""
    pattern = rf"(?s){element_pattern(tag, cls)}(.*?)</(?i:{tag})\s*>"
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), markup_text)


def container_pattern(tag: str, cls: str | None = None) -> str:
    """A whole container element, opening tag included."""
    return rf"(?s){element_pattern(tag, cls)}.*?</(?i:{tag})\s*>"


def attribute(fragment: Column, tag: str, attr: str | Column) -> Column:
    """Attribute of the first such tag inside a fragment, null when it is missing."""
    name = F.lit(attr) if isinstance(attr, str) else attr
    opening = F.regexp_extract(fragment, rf"(?s)<(?i:{tag})\s{IN_TAG}>", 0)
    pattern = F.concat(F.lit(r"\s(?i:"), name, F.lit(r""")\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""))
    found = [F.get(F.regexp_extract_all(opening, pattern, F.lit(i)), F.lit(0)) for i in (1, 2, 3)]
    return decode_entities(F.concat(*found))


VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
# A page as pieces that make up all of it: comments, scripts, styles, tags and the text between them.
PIECES = rf"(?si)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|{TAG}|[^<]++|<"
NAME = r"([a-zA-Z][^\s/>]*)"
OPEN_TAGS = "struct<stack:array<string>,first:int,depth:int,last:int>"


def _tags(pieces: Column, opening: str) -> Column:
    """The tags among the pieces: place, name opened, name closed, whether closed at once, whether it is the one looked for."""
    def described(p: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(p, f"^<{NAME}", 1))
        counts = ~name.isin("script", "style", *VOID_TAGS)
        return F.when(p.startswith("<"), F.struct(
            i.alias("at"), F.when(counts, name).otherwise("").alias("opens"), F.lower(F.regexp_extract(p, f"^</{NAME}", 1)).alias("closes"),
            p.endswith("/>").alias("empty"), (counts & p.rlike(opening)).alias("wanted")))

    return F.filter(F.transform(pieces, described), lambda t: (t["opens"] != "") | (t["closes"] != ""))


def nested_element(html: Column, tag: str, cls: str | None = None) -> Column:
    """Markup of the first such element up to the tag that ends it, whatever nests inside; null without one.

    Open tags are kept on a stack, as parsers do: an end tag closes all that was opened since its start tag, an
    end tag without one is ignored, and an element that nothing closes runs to the end of the page.
    """
    opening = f"(?s)^(?:{element_pattern(tag, cls)})$"
    start = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit(-1).alias("first"), F.lit(0).alias("depth"), F.lit(-1).alias("last"))

    def state(stack: Column, first: Column, depth: Column, last: Column) -> Column:
        return F.struct(stack.alias("stack"), first.alias("first"), depth.alias("depth"), last.alias("last")).cast(OPEN_TAGS)

    def step(a: Column, t: Column) -> Column:
        begins = t["wanted"] & (a["first"] < 0)
        pushed = F.when(t["empty"], a["stack"]).otherwise(F.concat(a["stack"], F.array(t["opens"])))
        opened = state(
            pushed, F.when(begins, t["at"]).otherwise(a["first"]), F.when(begins, F.size(pushed)).otherwise(a["depth"]),
            F.when(begins & t["empty"], t["at"]).otherwise(a["last"]))
        left = F.size(a["stack"]) - F.array_position(F.reverse(a["stack"]), t["closes"]).cast("int")
        ends = (a["first"] >= 0) & (a["last"] < 0) & (left < a["depth"])
        closed = state(F.slice(a["stack"], F.lit(1), left), a["first"], a["depth"], F.when(ends, t["at"]).otherwise(a["last"]))
        return F.when(t["opens"] != "", opened).when(F.array_contains(a["stack"], t["closes"]), closed).otherwise(a)

    def cut(pieces: Column) -> Column:
        def found(a: Column) -> Column:
            end = F.when(a["last"] < 0, F.size(pieces)).otherwise(a["last"] + 1)
            return F.when(a["first"] >= 0, F.array_join(F.slice(pieces, a["first"] + 1, end - a["first"]), ""))

        return F.aggregate(_tags(pieces, opening), start.cast(OPEN_TAGS), step, found)

    return let(F.regexp_extract_all(html, F.lit(PIECES), F.lit(0)), cut)


def nested_text(html: Column, tag: str, cls: str | None = None) -> Column:
    return markup_text(nested_element(html, tag, cls))
