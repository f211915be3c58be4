"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.functions import regex as R
from newspulse.functions import text as X


def with_text(df: DataFrame, column: str = "content") -> DataFrame:
    """Rows whose text has more than one character; missing text drops out."""
    return df.where(F.length(column) > 1)


def drop_placeholder(df: DataFrame, column: str = "title", placeholder: str = "[Removed]") -> DataFrame:
    """Drop withdrawn articles; a missing title stays."""
    return df.where(~F.col(column).eqNullSafe(placeholder))


def from_sources(df: DataFrame, sources: Iterable[str] | DataFrame, column: str = "source_id") -> DataFrame:
    """Articles of the given sources: a list of ids, or a table with the same id column."""
    if isinstance(sources, DataFrame):
        return df.join(sources.select(column), column, "left_semi")
    return df.where(F.col(column).isin(list(sources)))


def has_attribute(df: DataFrame, attr: Column, unwanted: object) -> DataFrame:
    """Rows that have the attribute with another value than the unwanted one."""
    return df.where(attr.isNotNull() & (attr != F.lit(unwanted)))


def relevance(text: Column, families: Mapping[str, Iterable[str]]) -> Column:
    """Topical test over four pattern families: ``drop``, ``drop_unless_allowed``, ``allow``, ``include``."""
    def hit(name: str) -> Column:
        return text.rlike(R.any_of(families[name]))

    excluded = hit("drop") | (hit("drop_unless_allowed") & ~hit("allow"))
    return hit("include") & ~excluded


def topical(
    df: DataFrame, families: Mapping[str, Iterable[str]], text_cols: Iterable[str] = ("title", "summary")
) -> DataFrame:
    """Keep the rows whose joined text columns are relevant."""
    return df.where(relevance(X.join_present(list(text_cols), df.columns), families))


def two_way_class(
    title: Column | str, families: Mapping[str, Iterable[str]], both: str = "Both", neither: str = "Other"
) -> Column:
    """Class of a title from exactly two families; both hit → ``both``, none or no title → ``neither``."""
    text = F.lower(F.col(title) if isinstance(title, str) else title)
    (a, a_patterns), (b, b_patterns) = families.items()
    in_a = F.coalesce(text.rlike(R.any_of(a_patterns)), F.lit(False))
    in_b = F.coalesce(text.rlike(R.any_of(b_patterns)), F.lit(False))
    return F.when(in_a & in_b, both).when(in_a, a).when(in_b, b).otherwise(neither)


def in_window(df: DataFrame, ts: str, first: date | Column, last: date | Column) -> DataFrame:
    """Rows whose timestamp falls on a day of the closed range.

    Compared as timestamps, not as ``to_date(ts)``: the bare column keeps the filter pushable to the
    scan and to partition pruning.
    """
    lo = F.lit(first) if isinstance(first, date) else first
    hi = F.lit(last) if isinstance(last, date) else last
    after = F.date_add(hi, 1).cast("timestamp")
    return df.where((F.col(ts) >= lo.cast("timestamp")) & (F.col(ts) < after))
