"""Lexicon sentiment: tokens with their context, one lexicon join, one row per text.

Every scorer explodes the tokens of a text next to the words before them, so context rules need no
window and no shuffle of tokens. The lexicon (one row per word, see ``unique_words``) is joined without
a hint: Catalyst broadcasts it while its size allows. The only shuffle is one partial-aggregate row
per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.functions import columns as C
from newspulse.functions import fixed
from newspulse.functions import text as X

# Published constants of the compound rule.
NEGATION = "-0.74"
CAPS = "0.733"
EXCLAMATION = "0.292"
BOOSTER_WEIGHT = {1: "1.00", 2: "0.95", 3: "0.90"}


def _dec(value: str, kind: str) -> Column:
    return F.lit(value).cast(kind)


def _shifted(words: Column, by: int) -> Column:
    """The word array moved ``by`` places to the right, nulls in front."""
    pad = F.array(*[F.lit(None).cast("string")] * by)
    return F.concat(pad, words)


def _kind(lexicon: DataFrame, kind: str, word: str, **columns: str) -> DataFrame:
    """The lexicon rows of one kind, columns renamed for a join."""
    rows = lexicon.where(F.col("kind") == kind)
    return rows.select(F.col("word").alias(word), *[F.col(c).alias(a) for a, c in columns.items()])


def unique_words(lexicon: DataFrame) -> DataFrame:
    """One row per word, for lexicon tables that may list a word twice (the scorers rely on it)."""
    return lexicon.dropDuplicates(["word"])


def _stacked(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, _field, _text): one row per text column. An exploded array, since that keeps the rows of a
    key where they are and the aggregate that follows can reuse their partitioning."""
    rows = F.array(*[F.struct(F.lit(c).alias("_field"), F.col(c).alias("_text")) for c in columns])
    return df.select(*keys, F.inline(rows))


def mean_valences(df: DataFrame, keys: list[str], columns: dict[str, str], lexicon: DataFrame) -> DataFrame:
    """Mean valence of the lexicon words of several text columns: (keys, hits_<out>, <out>) per column.

    ``columns`` maps output names to text columns. All are scored in one pass and one aggregate; no hit
    scores 0. Put columns that should ride along into ``keys``: that saves a join afterwards.
    """
    long = _stacked(df, keys, list(columns.values()))
    tokens = long.select(*keys, "_field", F.explode_outer(X.terms("_text")).alias("word"))
    sums = []
    for out, c in columns.items():
        v = F.when(F.col("_field") == c, F.col("valence"))
        sums += [F.sum(v).alias(f"_{out}"), F.count(v).alias(f"hits_{out}")]
    scored = tokens.join(_kind(lexicon, "valence", "word", valence="valence"), "word", "left").groupBy(*keys).agg(*sums)
    mean = lambda out: fixed.ratio(F.col(f"_{out}"), F.col(f"hits_{out}"))
    return scored.select(
        *keys, *[f"hits_{out}" for out in columns],
        *[F.coalesce(mean(out), F.lit(0.0)).alias(out) for out in columns],
    )


def mean_valence(
    df: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame, out: str = "sentiment"
) -> DataFrame:
    """(keys, hits, ``out``) of one text column."""
    return mean_valences(df, keys, {out: text_col}, lexicon).withColumnRenamed(f"hits_{out}", "hits")


def polarities(df: DataFrame, keys: list[str], columns: list[str], lexicon: DataFrame) -> DataFrame:
    """(keys, {col}_polarity, {col}_subjectivity, {col}_polarity_label) for several text columns, scored
    in one pass and one aggregate. A negation one word before turns and halves a hit."""
    words = F.col("_words")
    tokens = (
        _stacked(df, keys, columns)
        .select(*keys, "_field", X.terms("_text").alias("_words"))
        .select(*keys, "_field", F.explode_outer(F.arrays_zip(words.alias("w"), _shifted(words, 1).alias("p"))).alias("_t"))
        .select(*keys, "_field", F.col("_t.w").alias("word"), F.col("_t.p").alias("_before"))
    )
    hits = _kind(lexicon, "valence", "word", polarity="polarity", subjectivity="subjectivity")
    negations = _kind(lexicon, "negation", "_negation")
    factor = F.when(F.col("_negation").isNotNull(), _dec("-0.5", "decimal(2,1)")).otherwise(
        _dec("1.0", "decimal(2,1)")
    )
    sums = []
    for c in columns:
        here = F.col("_field") == c
        sums += [
            F.sum(F.when(here, F.col("polarity") * factor)).alias(f"_p_{c}"),
            F.sum(F.when(here, F.col("subjectivity"))).alias(f"_s_{c}"),
            F.count(F.when(here, F.col("polarity"))).alias(f"_n_{c}"),
        ]
    scored = (
        tokens.join(hits, "word", "left")
        # Only a hit needs its context: a null key skips the probe.
        .withColumn("_before", F.when(F.col("polarity").isNotNull(), F.col("_before")))
        .join(negations, F.col("_before") == F.col("_negation"), "left")
        .groupBy(*keys)
        .agg(*sums)
    )
    one, zero = F.lit(1.0), F.lit(0.0)
    out = []
    for c in columns:
        mean = lambda part, n=F.col(f"_n_{c}"), c=c: F.coalesce(fixed.ratio(F.col(f"_{part}_{c}"), n), zero)
        out += [
            F.greatest(F.least(mean("p"), one), -one).alias(f"{c}_polarity"),
            F.greatest(F.least(mean("s"), one), zero).alias(f"{c}_subjectivity"),
        ]
    labels = [C.polarity_label(F.coalesce(F.col(f"_p_{c}"), F.lit(0))).alias(f"{c}_polarity_label") for c in columns]
    return scored.select(*keys, *out, *labels)


def polarity(df: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame) -> DataFrame:
    """(keys, polarity, subjectivity, polarity_label) of one text column."""
    scored = polarities(df, keys, [text_col], lexicon)
    return scored.select(*keys, *[F.col(f"{text_col}_{p}").alias(p) for p in ("polarity", "subjectivity", "polarity_label")])


def _sign(x: Column) -> Column:
    return F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")


def _is_caps(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def _score_hits(tokens: DataFrame, distances: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``_s``: the valence of each hit after capitals, boosters and negations, nearest word first,
    then "but". One column per step: nested into each other the expressions would double every time.
    """
    v, but = F.col("valence"), F.col("_but")
    loud = v.isNotNull() & F.col("_mixed") & _is_caps(F.col("_raw_word"))
    out = tokens.withColumn("_s", F.when(loud, v + _sign(v) * _dec(CAPS, "decimal(4,3)")).otherwise(v))
    for d in distances:
        boost = F.coalesce(F.col(f"_boost{d}"), F.lit(0).cast("decimal(6,3)"))
        turn = F.when(F.col(f"_neg{d}"), _dec(NEGATION, "decimal(3,2)")).otherwise(_dec("1.00", "decimal(3,2)"))
        out = out.withColumn("_s", F.col("_s") + _sign(F.col("_s")) * boost * _dec(BOOSTER_WEIGHT[d], "decimal(3,2)"))
        out = out.withColumn("_s", F.col("_s") * turn)
    weight = (
        F.when((but > 0) & (F.col("_pos") < but), _dec("0.5", "decimal(2,1)"))
        .when((but > 0) & (F.col("_pos") > but), _dec("1.5", "decimal(2,1)"))
        .otherwise(_dec("1.0", "decimal(2,1)"))
    )
    return out.withColumn("_s", (F.col("_s") * weight).cast("decimal(18,10)"))


def compound(df: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame) -> DataFrame:
    """(keys, neg, neu, pos, compound, sentiment_text) by the published compound rule.

    Missing text has null scores and the neutral label.
    """
    text = F.col(text_col)
    marks = lambda m: F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))
    base = df.select(
        *keys,
        text.isNotNull().alias("_present"),
        marks("!").alias("_bang"),
        marks("?").alias("_ask"),
        X.chunks(text_col).alias("_raw"),
    ).withColumn("_low", F.transform("_raw", F.lower))
    low = F.col("_low")
    zipped = F.arrays_zip(
        F.col("_raw").alias("raw"), low.alias("w"),
        *[_shifted(low, d).alias(f"p{d}") for d in (1, 2, 3)],
    )
    per_text = ["_present", "_bang", "_ask", "_words", "_mixed", "_but"]
    # Everything per text is a column before the tokens are exploded: computed in the same step it would
    # be evaluated per token and carry both word arrays along.
    prepared = base.select(
        *keys, "_present", "_bang", "_ask", "_raw", "_low",
        F.size("_low").alias("_words"),
        (F.exists("_raw", _is_caps) & F.exists("_raw", lambda w: ~_is_caps(w))).alias("_mixed"),
        F.array_position(low, "but").alias("_but"),
    )
    tokens = prepared.select(*keys, *per_text, F.posexplode_outer(zipped).alias("_i", "_t")).select(
        *keys, *per_text, (F.col("_i") + 1).alias("_pos"),
        F.col("_t.w").alias("word"), F.col("_t.raw").alias("_raw_word"),
        *[F.col(f"_t.p{d}").alias(f"_p{d}") for d in (1, 2, 3)],
    )
    scored = tokens.join(_kind(lexicon, "valence", "word", valence="valence"), "word", "left")
    context = lexicon.where(F.col("kind").isin("booster", "negation"))
    for d in (1, 2, 3):
        near = context.select(
            F.col("word").alias(f"_k{d}"),
            F.when(F.col("kind") == "booster", F.col("valence")).alias(f"_boost{d}"),
            (F.col("kind") == "negation").alias(f"_isneg{d}"),
        )
        probe = F.when(F.col("valence").isNotNull(), F.col(f"_p{d}"))
        scored = (
            scored.withColumn(f"_p{d}", probe)
            .join(near, F.col(f"_p{d}") == F.col(f"_k{d}"), "left")
            .withColumn(f"_neg{d}", F.coalesce(f"_isneg{d}", F.lit(False)))
        )
    one = F.lit(1).cast("decimal(1,0)")
    sums = (
        _score_hits(scored).groupBy(*keys)
        .agg(
            *[F.max(c).alias(c) for c in per_text],
            F.sum("_s").alias("_sum"),
            F.sum(F.when(F.col("_s") > 0, F.col("_s") + one)).alias("_up"),
            F.sum(F.when(F.col("_s") < 0, one - F.col("_s"))).alias("_down"),
            F.count(F.when(F.col("_s") != 0, 1)).alias("_hits"),
        )
    )
    bang = F.least("_bang", F.lit(4)) * _dec(EXCLAMATION, "decimal(4,3)")
    ask = (
        F.when(F.col("_ask") > 3, _dec("0.96", "decimal(3,2)"))
        .when(F.col("_ask") > 1, F.col("_ask") * _dec("0.18", "decimal(3,2)"))
        .otherwise(_dec("0.00", "decimal(3,2)"))
    )
    zero = F.lit(0).cast("decimal(28,10)")
    shares = sums.select(
        *keys, "_present", (F.col("_words") - F.col("_hits")).cast("double").alias("_neutral"),
        (bang + ask).cast("double").alias("_loud"),
        *[F.coalesce(c, zero).cast("double").alias(c) for c in ("_sum", "_up", "_down")],
    )
    s = F.col("_sum") + F.signum("_sum") * F.col("_loud")
    up = F.col("_up") + F.when(F.col("_up") > F.col("_down"), F.col("_loud")).otherwise(0.0)
    down = F.col("_down") + F.when(F.col("_down") > F.col("_up"), F.col("_loud")).otherwise(0.0)
    final = shares.select(
        *keys, "_present", "_neutral", s.alias("_s"), up.alias("_u"), down.alias("_d"),
        (up + down + F.col("_neutral")).alias("_all"),
    )
    share = lambda x: F.coalesce(F.round(F.try_divide(F.col(x), F.col("_all")), 3), F.lit(0.0))
    present = lambda x: F.when(F.col("_present"), x)
    score = F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15), 4)
    return final.select(
        *keys,
        present(share("_d")).alias("neg"), present(share("_neutral")).alias("neu"),
        present(share("_u")).alias("pos"), present(score).alias("compound"),
    ).withColumn("sentiment_text", C.compound_label("compound"))


def score_struct(df: DataFrame) -> DataFrame:
    """The four scores as one struct column, the form they have before expansion."""
    scores = ["neg", "neu", "pos", "compound"]
    return df.withColumn("scores", F.struct(*scores)).drop(*scores)


def expand_scores(df: DataFrame, column: str = "scores") -> DataFrame:
    """A struct of scores into one column per score; the other columns stay."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def score_with(df: DataFrame, text_col: str, scorer, out: str = "scores") -> DataFrame:
    """Attach a user's own model: ``scorer`` is a pandas UDF over the text (model loaded once per worker)."""
    return df.withColumn(out, scorer(F.col(text_col)))
