"""Bytes of a page to text, by its byte-order mark or the encoding it declares."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from newspulse.functions.rows import let

# Bytes in which a declaration has to stand.
DECLARED_WITHIN = 1024
DECLARATION = r"""(?i)<meta\s[^>]*?charset\s*=\s*["']?\s*([a-z0-9_:.-]+)|<\?xml\s[^>]*?encoding\s*=\s*["']([a-z0-9_:.-]+)"""
# Labels of the encoding standard for the two families a page in bytes may declare.
UTF8_LABELS = ("utf-8", "utf8", "unicode-1-1-utf-8", "unicode11utf8", "unicode20utf8", "x-unicode20utf8")
LATIN_LABELS = (
    "iso-8859-1", "iso8859-1", "iso88591", "iso_8859-1", "iso_8859-1:1987", "latin1", "l1", "cp819", "ibm819", "csisolatin1",
    "iso-ir-100", "ascii", "us-ascii", "ansi_x3.4-1968", "windows-1252", "cp1252", "x-cp1252",
)
# What the bytes 80 to 9F stand for under these labels; five are unused and stay controls.
LATIN_CONTROLS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
LATIN_SIGNS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _mark(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FEFF"), "utf-16be").when(head.startswith("FFFE"), "utf-16le")
    )


def declared(content: Column) -> Column:
    """Label that the first bytes declare, lower-case; null without one."""
    head = F.decode(F.substring(content, 1, DECLARED_WITHIN), "ISO-8859-1")
    found = F.coalesce(*[F.nullif(F.regexp_extract(head, DECLARATION, i), F.lit("")) for i in (1, 2)])
    return F.lower(found)


def encoding_of(content: Column) -> Column:
    """``utf-8``, ``utf-16le``, ``utf-16be`` or ``windows-1252``: the byte-order mark, else the declaration, else
    UTF-8 where the bytes are valid in it, else windows-1252.

    As in browsers, Latin-1 and ASCII labels mean windows-1252, and a declared UTF-16 that could be read as
    bytes is UTF-8. An unknown label counts as none.
    """
    label = declared(content)
    guess = F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("windows-1252")
    by_label = F.when(label.isin(*UTF8_LABELS) | label.startswith("utf-16"), "utf-8").when(label.isin(*LATIN_LABELS), "windows-1252")
    return F.coalesce(_mark(content), by_label, guess)


def decoded(content: Column, encoding: Column) -> Column:
    """Text of the bytes without their byte-order mark; bytes that are no character become U+FFFD.

    UTF-16 with a lone half of a pair needs ``lenient`` decoding around the select, as ``html_page_files`` does.
    """
    marked = _mark(content).isNotNull()
    wide = F.substring(content, F.lit(3), F.octet_length(content) - 2)
    even = lambda c: F.substring(c, F.lit(1), F.floor(F.octet_length(c) / 2).cast("int") * 2)
    narrow = F.when(marked, F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    latin = F.translate(F.decode(content, "ISO-8859-1"), LATIN_CONTROLS, LATIN_SIGNS)
    return (
        F.when(encoding == "utf-8", F.make_valid_utf8(narrow.cast("string")))
        .when(encoding == "utf-16le", let(wide, lambda c: F.decode(even(c), "UTF-16LE")))
        .when(encoding == "utf-16be", let(wide, lambda c: F.decode(even(c), "UTF-16BE")))
        .otherwise(latin)
    )


class lenient:
    """While this lasts, selects are analysed so that malformed bytes become U+FFFD instead of ending the job."""

    NAME = "spark.sql.legacy.codingErrorAction"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.NAME)
        self.conf.set(self.NAME, "true")

    def __exit__(self, *_):
        self.conf.set(self.NAME, self.before)
