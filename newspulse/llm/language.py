"""Language identification by hierarchical discrimination: the family first, then the language within it.

A text is the normalised counts of its hashed byte trigrams. One-versus-one linear support vector machines tell
the families apart, and, within a family, its languages. The machines learn from a bounded sample of texts.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse.llm.common import ref, text_udf
from newspulse.llm.linear import held_out, may_learn, sample_by, train_svm

UNKNOWN = "und"
DIMENSIONS = 4096
SAMPLE = 2400  # texts to learn from, in equal shares of the languages
BLOCK = 1 << 20
SHARPNESS = 3.0

# Families of common languages by their ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayo-polynesian": ("id", "jv", "mg", "ms", "su", "tl"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def trigram_counts(text: str) -> np.ndarray:
    """Square roots of the counts of hashed byte trigrams of the whole lower-cased text, of length one."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(data) - 2, BLOCK):
        part = data[at:at + BLOCK + 2].astype(np.uint32)
        name = (part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77)) ^ (part[2:] * np.uint32(0xC2B2AE3D))
        name ^= name >> np.uint32(15)
        counts += np.bincount((name * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-9)).astype(np.float32)


@dataclass(frozen=True)
class Choice:
    """One-versus-one machines among ``names``: row i of ``weights`` prefers the first of ``pairs[i]``."""

    names: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Choice:
        names = tuple(sorted(set(labels.tolist())))
        pairs, weights = [], []
        for i, j in itertools.combinations(range(len(names)), 2):
            both = (labels == names[i]) | (labels == names[j])
            pairs.append((i, j))
            weights.append(train_svm(x[both], labels[both] == names[i]))
        return cls(names, tuple(pairs), np.array(weights, np.float32).reshape(len(pairs), -1))

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """The name with the greatest mean of its pairwise probabilities, ties to the first, and that mean."""
        if not self.pairs:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        first = 1 / (1 + np.exp(-SHARPNESS * margins.astype(np.float64)))
        votes = np.zeros(len(self.names))
        for (i, j), p in zip(self.pairs, first):
            votes[i] += p
            votes[j] += 1 - p
        best = int(votes.argmax())
        return self.names[best], float(votes[best] / (len(self.names) - 1))


@dataclass(frozen=True)
class Model:
    families: Choice
    languages: dict[str, Choice]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model | None:
        if not langs:
            return None
        labels = np.array(langs, object)
        groups = np.array([FAMILY_OF.get(lang, lang) for lang in langs], object)
        return cls(Choice.fit(x, groups), {g: Choice.fit(x[groups == g], labels[groups == g]) for g in sorted(set(groups))})

    def predict(self, text: str) -> tuple[str, float]:
        x = trigram_counts(text)
        family, p = self.families.decide(x)
        lang, q = self.languages[family].decide(x)
        return lang, p * q


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Fit to about ``sample`` texts with a language and a letter that are not held out; None if there are none."""
    rows = docs.select(ref(key).alias("key"), ref(text).cast("string").alias("text"), ref(lang).alias("lang"))
    rows = rows.where(may_learn(F.col("key")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    vector = text_udf(lambda: lambda t: (trigram_counts(t or "").astype(np.float16).tobytes(),),
                      T.StructType([T.StructField("v", T.BinaryType())]))
    found = sample_by(rows, "lang", "key", sample).select("key", "lang", vector(F.col("text"))["v"].alias("v")).collect()
    found.sort(key=lambda r: (r["key"], r["lang"], r["v"]))
    x = np.array([np.frombuffer(r["v"], np.float16) for r in found], np.float32)
    return Model.fit(x, [r["lang"] for r in found])


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, held_out, lang_pred and score of each row of ``docs``, from its whole text alone.

    Texts that are null or without a letter, and all texts if nothing was learned, are ``und`` with score 0.
    Equal texts get equal results, repeated rows stay repeated, an empty table gives an empty result.
    """
    def make():
        def one(body):
            if model is None or not any(map(str.isalpha, body or "")):
                return UNKNOWN, 0.0
            return model.predict(body)
        return one

    rows = docs.select(
        ref(key).alias(key), held_out(ref(key)).alias("held_out"), text_udf(make, PREDICTION)(ref(text).cast("string")).alias("p__"))
    return rows.select(ref(key), "held_out", "p__.lang_pred", "p__.score")
