"""Labels, link parts, timestamps and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def polarity_label(c: Column | str) -> Column:
    """negative / neutral / positive around zero; a missing score is neutral."""
    x = F.coalesce(_col(c), F.lit(0))
    return F.when(x < 0, "negative").when(x == 0, "neutral").otherwise("positive")


def compound_label(c: Column | str) -> Column:
    """positive from 0.05, negative from -0.05, both inclusive; a missing score is neutral."""
    x = _col(c)
    return F.when(x >= 0.05, "positive").when(x <= -0.05, "negative").otherwise("neutral")


def link_segments(c: Column | str) -> Column:
    """Path segments between host and last segment, empty ones removed.

    The last segment is dropped even when it is the only one, so a bare host has no segments.
    """
    parts = F.split(_col(c), "/")
    inner = F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 4, F.lit(0)))
    return F.filter(inner, lambda s: s != "")


def link_category(c: Column | str, level: int) -> Column:
    """The ``level``-th (0-based) link segment, null when there is none."""
    return F.get(link_segments(c), F.lit(level))


def iso_timestamp(c: Column | str) -> Column:
    """Parse ISO timestamps; malformed input is an error under ANSI mode, as in a strict parse."""
    return F.to_timestamp(_col(c))


def compact_timestamp(c: Column | str) -> Column:
    """Parse ``yyyyMMddTHHmmss``; anything else becomes null."""
    return F.try_to_timestamp(_col(c), F.lit("yyyyMMdd'T'HHmmss"))


def age_years(born: Column | str, today: Column) -> Column:
    """Whole years by comparing month and day (29 February counts from 1 March in common years)."""
    b = _col(born)
    before_birthday = F.date_format(today, "MMdd") < F.date_format(b, "MMdd")
    return F.year(today) - F.year(b) - before_birthday.cast("int")


def keep_when(flag: Column | str, c: Column | str) -> Column:
    """The value where the flag is true, null elsewhere."""
    return F.when(_col(flag), _col(c))
