"""Cleaning, normalising and tokenising text, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newspulse.functions import regex as R


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    """Missing text counts as empty text, so no placeholder word gets scored."""
    return F.coalesce(_col(c), F.lit(""))


def _one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


# Fixed value: the read-aloud boilerplate that one outlet leaves in its article text.
READ_ALOUD = rf"Læs opOrdbogTekstAf {R.WORD}* [A-Z][a-z]*"
# Fixed value: separator phrase between paragraphs in one outlet's article text.
SPLIT_ELEMENT = "--------- SPLIT ELEMENT ---------"
# Fixed value: marker some feeds leave in place of markup.
HTML_MARKER = "{html}"


def clean_news(c: Column | str) -> Column:
    """News cleaning that keeps case: markers, tags, links and digits become spaces.

    The boilerplate rule runs after digits are gone and deletes its match.
    """
    out = F.replace(text_or_empty(c), F.lit(HTML_MARKER), F.lit(" "))
    out = F.regexp_replace(out, R.TAG, " ")
    out = F.regexp_replace(out, R.LINK, " ")
    out = F.regexp_replace(out, R.DIGITS, " ")
    out = F.regexp_replace(out, READ_ALOUD, "")
    return _one_line(out)


# Letters, white space, the digits 0 and 9 and the en dash; all other characters go.
NOT_WHITELISTED = f"[{R.body(R.complement(R.LETTERS + R.SPACES + R.points('09–')))}]+"
NOT_TOPICAL = f"[{R.body(R.complement(R.LETTERS + R.points(' ')))}]+"


def clean_tech(c: Column | str) -> Column:
    """English cleaning by character whitelist.

    The whitelist holds the digits 0 and 9 and an en dash, not the range 0-9, and runs first: markup
    and full stops are gone before any tag or period rule could match, so those rules are left out.
    """
    out = F.regexp_replace(text_or_empty(c), NOT_WHITELISTED, "")
    out = F.regexp_replace(out, R.LINK, " ")
    out = F.regexp_replace(out, R.DIGITS, " ")
    out = _one_line(out)
    return F.regexp_replace(out, r"^\r+|\r+\z", " ")


def squeeze(c: Column | str) -> Column:
    """Newlines, the separator phrase and no-break spaces become spaces; runs of spaces become one."""
    out = _one_line(_col(c))
    out = F.replace(out, F.lit(SPLIT_ELEMENT), F.lit(" "))
    out = F.replace(out, F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(out, " +", " ")


def topic_words(c: Column | str, min_length: int = 4) -> Column:
    """Lower-case letter runs of at least ``min_length`` characters, for topic models.

    Tags, links and all characters but letters and plain spaces are deleted, not replaced, so words
    on both sides of a newline or tag are glued together.
    """
    out = F.lower(text_or_empty(c))
    out = F.replace(out, F.lit(HTML_MARKER), F.lit(""))
    out = F.regexp_replace(out, R.TAG, "")
    out = F.regexp_replace(out, R.LINK, "")
    out = F.regexp_replace(out, NOT_TOPICAL, "")
    return F.regexp_extract_all(out, F.lit(rf"[a-z]{{{min_length},}}"), F.lit(0))


def terms(c: Column | str) -> Column:
    """Lower-cased words in reading order."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(R.TERM), F.lit(0))


def count_terms(c: Column | str) -> Column:
    """Lower-cased runs of two or more word characters (the count-vectoriser rule)."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(R.TERM2), F.lit(0))


def chunks(c: Column | str) -> Column:
    """White-space separated chunks, punctuation stripped from both ends, case kept."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(R.CHUNK), F.lit(0))


def phrase_tokens(c: Column | str) -> Column:
    """Words plus phrase-breaking punctuation marks, case kept."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(R.PHRASE_TOKEN), F.lit(0))


def split_spaces(c: Column | str) -> Column:
    """Split at every single space; an empty text gives one empty token."""
    return F.split(_col(c), " ")


def concat_strict(*cols: Column | str) -> Column:
    """Join by a space; null as soon as one part is null."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        parts.append(_col(c))
    return F.concat(*parts)


def join_present(columns: list[str], available: list[str]) -> Column:
    """Lower-cased join of the non-null ones among ``columns``; columns not in the table are ignored."""
    return F.lower(F.concat_ws(" ", *[F.col(c) for c in columns if c in available]))


def entity_text(c: Column | str) -> Column:
    """Strip apostrophes, full stops and hyphens from entity text; a double quote becomes a space."""
    return F.translate(_col(c), "\"'.-", " ")


def entity_key(c: Column | str) -> Column:
    """Join key of an entity: the stripped text, lower-cased and without spaces."""
    return F.translate(F.lower(entity_text(c)), " ", "")


def first_line(c: Column | str) -> Column:
    """The text before the first newline: the title of a document that has no title column."""
    return F.substring_index(_col(c), "\n", 1)
