"""Stopwords, word classes and entity surfaces, hand-written and small; tables of any size can replace them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from newspulse.functions.rows import small_table

# English function words.
FUNCTION_WORDS = """
a about above after again against all also although am an and any are around as at be because been
before being below between both but by can could did do does doing down during each either else
ever every few for from further had has have having he her here hers herself him himself his how i
if in into is it its itself just less many may me might more most much must my myself neither no
nor not now of off on once only or other our ours out over own perhaps quite rather same shall she
should since so some such than that the their theirs them themselves then there these they this
those though through thus to too toward under until up upon us very was we were what when where
whether which while who whom whose why will with within without would yet you your yours yourself
""".split()
# Words news texts are full of whatever their topic.
NEWS_WORDS = "said says told news report reports reported today yesterday week year years here click read".split()

# Word classes: j adjective, r adverb; anything unlisted counts as a noun.
ADJECTIVES = "new good high special local great small large early late free bad".split()
ADVERBS = "really already still early often always never soon quickly slowly".split()
VERBS = "make take give find know think come want look".split()


def stopwords(*lists: Iterable[str]) -> list[str]:
    """Union of word lists; the two lists of this module by default."""
    return sorted(set().union(*(lists or (FUNCTION_WORDS, NEWS_WORDS))))


def stopword_table(spark: SparkSession, *lists: Iterable[str]) -> DataFrame:
    return small_table(spark, [(w,) for w in stopwords(*lists)], "word string")


def class_rows() -> list[tuple[str, str]]:
    rows = [(w, "a") for w in ADJECTIVES]
    rows += [(w, "r") for w in ADVERBS if w not in ADJECTIVES]
    return rows + [(w, "v") for w in VERBS]


def class_table(spark: SparkSession, rows: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    unique = dict(class_rows() if rows is None else rows)
    return small_table(spark, list(unique.items()), "word string, pos string")


# Entity surfaces, lower-case, one to three words.
GAZETTEER = {
    "PER": "lars løkke|angela merkel|christine lagarde|jerome powell",
    "LOC": "denmark|danmark|copenhagen|københavn|russia|rusland|united states|new york|new york city",
    "ORG": "european central bank|federal reserve|united nations|google|apple|microsoft|new york times",
    "MISC": "world cup|nobel prize",
}


def gazetteer_rows() -> list[tuple[str, str]]:
    return [(s, label) for label, names in GAZETTEER.items() for s in names.split("|")]


def gazetteer(spark: SparkSession, rows: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    unique = dict(gazetteer_rows() if rows is None else rows)
    return small_table(spark, list(unique.items()), "surface string, label string")
