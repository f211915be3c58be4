"""Own small sentiment lexicon for news English and Danish, written by hand for this package.

Rows: word, valence (about -4..4), polarity (-1..1), subjectivity (0..1), kind. Boosters carry their
strength in ``valence``. Larger lexicons are passed to the scorers as tables of the same shape.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newspulse.functions.rows import small_table

LEXICON_SCHEMA = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("valence", T.DecimalType(6, 3), True),
    T.StructField("polarity", T.DecimalType(4, 3), True),
    T.StructField("subjectivity", T.DecimalType(4, 3), True),
    T.StructField("kind", T.StringType(), False),
])

# strength -> words; polarity is a quarter of it.
POSITIVE = {
    "3.1": "excellent wonderful love triumph superb",
    "2.4": "great happy win wins won victory joy success brilliant",
    "1.9": "good gain gains growth strong improve improved hope safe praise celebrate beautiful",
    "1.3": "fine support recovery stable agree better progress benefit free glad god",
}
NEGATIVE = {
    "-3.2": "murder war terror catastrophe kill killed death worthless",
    "-2.5": "terrible crisis attack crash hate violence disaster trash idiot moron pathetic",
    "-1.9": "bad loss losses fear weak fraud stupid loser guilty crime sad krimi død",
    "-1.2": "problem risk decline worry cut delay doubt worse complain poor dreadful dårlig",
}
BOOSTERS = {
    "0.293": "very extremely really highly hugely remarkably meget",
    "-0.293": "slightly somewhat barely hardly partly lidt",
}
NEGATIONS = "not no never neither nor without cannot can't don't isn't wasn't won't ikke aldrig"

Row = tuple[str, str | None, str | None, str | None, str]


def default_rows() -> list[Row]:
    rows: list[Row] = []
    for strengths in (POSITIVE, NEGATIVE):
        for valence, words in strengths.items():
            polarity = str(Decimal(valence) / 4)[:6]
            subjectivity = str(min(Decimal("1"), abs(Decimal(valence)) / 4 + Decimal("0.1")))
            rows += [(w, valence, polarity, subjectivity, "valence") for w in words.split()]
    for strength, words in BOOSTERS.items():
        rows += [(w, strength, None, None, "booster") for w in words.split()]
    rows += [(w, None, None, None, "negation") for w in NEGATIONS.split()]
    return rows


def lexicon(spark: SparkSession, rows: Iterable[Row] | None = None) -> DataFrame:
    def dec(x: str | None, scale: str) -> Decimal | None:
        return None if x is None else Decimal(x).quantize(Decimal(scale))

    # A word has one entry: a later one replaces an earlier one.
    unique = {row[0]: row for row in (default_rows() if rows is None else rows)}
    data = [(w, dec(v, "0.001"), dec(p, "0.001"), dec(s, "0.001"), k) for w, v, p, s, k in unique.values()]
    return small_table(spark, data, LEXICON_SCHEMA)
