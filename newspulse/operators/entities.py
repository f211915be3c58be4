"""Entity mentions by gazetteer and their sentiment statistics.

Mentions live in a long table (key, pos, text, label) from the start; there is never a column per
entity. Overlaps are settled within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.functions import fixed
from newspulse.functions import text as X
from newspulse.functions.rows import exploded, small_table
from newspulse.schemas import MENTIONS
from newspulse.session import stage

SMALL_INDEX = 20_000  # prefix rows that travel with the plan; a larger index is a stored table
INDEX = "depth int, head string, word string, prefix string, deepest int, label string"


def prefix_index(gazetteer: DataFrame) -> DataFrame:
    """Every beginning of every name: (depth, head, word, prefix, deepest, label).

    ``head`` and the next ``word`` make ``prefix``, the first ``depth`` words of some name; ``head`` is empty at
    depth 1. Names are cut into words as texts are. ``label`` is set where a name ends (the least one, should a
    name be listed twice), ``deepest`` is the number of words of the longest name that goes on from there. A
    small index becomes a local relation with an exact size, which Catalyst broadcasts; a large one is stored and
    joined as Catalyst sees fit.
    """
    names = gazetteer.select(X.phrase_tokens(F.lower("surface")).alias("w"), "label").where(F.size("w") > 0)
    cut = names.select("w", "label", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("depth"))
    joined = lambda n: F.array_join(F.slice("w", F.lit(1), n), " ")
    index = cut.groupBy(
        "depth", joined(F.col("depth") - 1).alias("head"), F.element_at("w", F.col("depth")).alias("word"),
        joined(F.col("depth")).alias("prefix"),
    ).agg(
        F.max(F.size("w")).alias("deepest"),
        F.min(F.when(F.size("w") == F.col("depth"), F.col("label"))).alias("label"),
    )
    few = index.limit(SMALL_INDEX + 1).collect()
    if len(few) <= SMALL_INDEX:
        return small_table(gazetteer.sparkSession, [tuple(r) for r in few], INDEX)
    return stage(index, "names")


def longest_names(df: DataFrame, keys: list[str], text_col: str, index: DataFrame) -> DataFrame:
    """The longest name that begins at each place of a text, of any number of words: (keys, pos, n, text, label).

    Each token probes the first words of the names. The few that start one go on word by word, level by level,
    as long as some name does; how many levels there are is read from the index.
    """
    depth = index.agg(F.max("depth")).first()[0] or 0
    tokens = df.select(*keys, X.phrase_tokens(text_col).alias("_tokens"))
    rows = tokens.select(*keys, "_tokens", F.posexplode_outer("_tokens").alias("pos", "_token")).where(F.col("pos").isNotNull())
    # The words of a name ride along as references into the array; only tokens that start one are written out.
    run = F.slice("_tokens", F.col("pos") + 1, F.lit(max(depth, 1)))
    rows = rows.select(*keys, "pos", F.lower("_token").alias("_word"), run.alias("_run"))
    first = index.where("depth = 1").select(F.col("word").alias("_word"), F.col("prefix").alias("_head"), "deepest", "label")
    rows = rows.join(first, "_word").withColumn("n", F.when(F.col("label").isNotNull(), F.lit(1)))
    for level in range(2, depth + 1):
        here = index.where(F.col("depth") == level).select(
            F.col("head").alias("_head"), F.col("word").alias("_word"), F.col("prefix").alias("_on"),
            F.col("deepest").alias("_deepest"), F.col("label").alias("_label"))
        # A name that cannot go on has no next word, and a null key skips the probe.
        word = F.when(F.col("deepest") >= level, F.lower(F.get("_run", F.lit(level - 1))))
        rows = rows.withColumn("_word", word).join(here, ["_head", "_word"], "left").select(
            *keys, "pos", "_run", F.col("_on").alias("_head"), F.col("_deepest").alias("deepest"),
            F.coalesce("_label", "label").alias("label"), F.when(F.col("_label").isNotNull(), F.lit(level)).otherwise(F.col("n")).alias("n"))
    text = F.array_join(F.slice("_run", F.lit(1), F.col("n")), " ")
    return rows.where(F.col("label").isNotNull()).select(*keys, "pos", "n", text.alias("text"), "label")


def _record(**fields: Column) -> Column:
    """A struct with field names that survive inside a lambda (aliases do not)."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def _left_to_right(found: Column, chunk: int = 64) -> Column:
    """Walk the matches of one text from left to right; a match inside an accepted one is dropped.

    Accepted matches are gathered in chunks: adding to one long array would copy all of it every time.
    """
    empty = F.array().cast(MENTIONS)
    start = _record(free_from=F.lit(0), full=F.array().cast(f"array<{MENTIONS}>"), kept=empty)

    def step(acc: Column, m: Column) -> Column:
        mention = F.array(_record(pos=m["pos"], text=m["text"], label=m["label"]))
        end = m["pos"] + m["n"]
        more = _record(free_from=end, full=acc["full"], kept=F.concat(acc["kept"], mention))
        next_chunk = _record(free_from=end, full=F.concat(acc["full"], F.array(acc["kept"])), kept=mention)
        return F.when(m["pos"] < acc["free_from"], acc).when(F.size(acc["kept"]) < chunk, more).otherwise(next_chunk)

    return F.aggregate(found, start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["kept"]))


def mention_lists(df: DataFrame, key: str | list[str], text_col: str, gazetteer: DataFrame) -> DataFrame:
    """(key, entities): the mentions of each text that has any, in order, the longest name winning.

    ``gazetteer`` is (surface, label) with names of any length, or their ``prefix_index`` if several tables are
    searched for the same names. Columns that should ride along (the outlet) can be listed with the key, which
    saves a join afterwards.
    """
    keys = [key] if isinstance(key, str) else key
    index = gazetteer if "prefix" in gazetteer.columns else prefix_index(gazetteer)
    matches = longest_names(df, keys, text_col, index)
    return (
        matches.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "n", "text", "label"))).alias("_found"))
        .select(*keys, _left_to_right(F.col("_found")).alias("entities"))
    )


def mentions(lists: DataFrame, key: str) -> DataFrame:
    """Long form (key, pos, text, label)."""
    return exploded(lists, [key], "entities", "_m").select(key, "_m.*")


def pattern_mentions(df: DataFrame, key: str, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """Mentions of typed patterns (licence names, mail addresses): (key, ordinal, text, label)."""
    def found_of(label: str, pattern: str) -> Column:
        texts = F.regexp_extract_all(X.text_or_empty(text_col), F.lit(pattern), F.lit(0))
        return F.transform(texts, lambda m, i: _record(ordinal=i, text=m, label=F.lit(label)))

    found = F.flatten(F.array(*[found_of(label, pattern) for label, pattern in patterns.items()]))
    return exploded(df, [key], found, "_m").select(key, "_m.*")


def entity_string(entities: Column | str) -> Column:
    """Mentions joined by commas and stripped of apostrophes, full stops, hyphens and quotes."""
    e = F.col(entities) if isinstance(entities, str) else entities
    return X.entity_text(F.array_join(F.transform(e, lambda m: m["text"]), ","))


def entity_terms(entities: Column | str, unit: str = "mention") -> Column:
    """What counts as one entity: the whole mention's key, or each word of the entity string.

    Single words never match the type of a multi-word mention; ``token`` is there to reproduce that.
    """
    if unit == "token":
        return X.count_terms(entity_string(entities))
    e = F.col(entities) if isinstance(entities, str) else entities
    return F.transform(e, lambda m: X.entity_key(m["text"]))


def entity_counts(lists: DataFrame, key: str, unit: str = "token") -> DataFrame:
    """(key, term, n)."""
    return (
        exploded(lists, [key], entity_terms("entities", unit), "term")
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def entity_totals(lists: DataFrame, group: str = "medie", unit: str = "token") -> DataFrame:
    """Mentions per entity and group, one pass for all groups: (group, term, n)."""
    return (
        exploded(lists, [group], entity_terms("entities", unit), "term")
        .groupBy(group, "term")
        .agg(F.sum(F.lit(1)).alias("n"))
    )


def entity_types(lists: DataFrame, key: str) -> DataFrame:
    """(entity, entity_type): the label of the last mention in key and text order."""
    return (
        mentions(lists, key)
        .groupBy(X.entity_key("text").alias("entity"))
        .agg(F.max_by("label", F.struct(key, "pos")).alias("entity_type"))
    )


def entity_sentiment(scored: DataFrame, group: str = "medie", unit: str = "mention") -> DataFrame:
    """Per group and entity: mean and count of content and title sentiment, each article once.

    ``scored`` has the group, ``entities``, ``sentiment_content`` and ``sentiment_title`` on one row.
    """
    once = F.array_distinct(entity_terms("entities", unit))
    rows = exploded(scored, [group, "sentiment_content", "sentiment_title"], once, "entity")
    return rows.groupBy(group, "entity").agg(
        fixed.mean("sentiment_content").alias("average_sentiment"),
        F.count("sentiment_content").alias("count"),
        fixed.mean("sentiment_title").alias("average_sentiment_title"),
        F.count("sentiment_title").alias("count_title"),
    )


def attach_types(entities: DataFrame, types: DataFrame) -> DataFrame:
    """Add the entity type; entities without one keep null."""
    return entities.join(types, "entity", "left")


def entity_polarity(scored: DataFrame, key: str, polarity_columns: list[str], pairing: str = "zip") -> DataFrame:
    """Mean, sample variance and count of each polarity per (Entity, Entity_Type), plus one sample article.

    ``zip`` pairs every mention with its own type. ``cross`` pairs every mention of an article with
    every mention's type in that article. The quadratic pair list is never built: a mention meets each
    distinct label once, weighted by how often the label occurs, and there are only as many labels as
    the gazetteer has. The sample is the first article by ``key``; its scores ride along.
    """
    if pairing == "zip":
        pairs = exploded(scored, [key, *polarity_columns], "entities", "_m").select(
            key, *polarity_columns, F.col("_m.text").alias("Entity"), F.col("_m.label").alias("Entity_Type"),
            F.lit(1).alias("_w"),
        )
    elif pairing == "cross":
        labels = F.array_distinct(F.transform("entities", lambda m: m["label"]))
        weighted = F.transform(
            labels,
            lambda t: _record(Entity_Type=t, _w=F.size(F.filter("entities", lambda m: m["label"] == t))),
        )
        typed = scored.select(key, *polarity_columns, "entities", weighted.alias("_types"))
        single = exploded(typed, [key, *polarity_columns, "_types"], "entities", "_m")
        pairs = single.select(key, *polarity_columns, F.col("_m.text").alias("Entity"), F.inline_outer("_types"))
    else:
        raise ValueError(f"pairing must be 'zip' or 'cross', not {pairing!r}")
    sums = []
    for p in polarity_columns:
        w, x = F.when(F.col(p).isNotNull(), F.col("_w")).cast("decimal(9,0)"), F.col(p).cast("double")
        sums += [F.sum(w).alias(f"_n_{p}"), F.sum(fixed.exact(x) * w).alias(f"_s_{p}"), F.sum(fixed.exact(x * x) * w).alias(f"_q_{p}")]
    grouped = pairs.groupBy("Entity", "Entity_Type").agg(
        *sums, F.min(key).alias(f"sample_{key}"), *[F.min_by(p, key).alias(p) for p in polarity_columns]
    )
    stats = []
    for p in polarity_columns:
        n, s, q = (F.col(f"_{x}_{p}").cast("double") for x in "nsq")
        stats += [
            (s / n).alias(f"mean_{p}"),
            F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))).alias(f"var_{p}"),
            F.coalesce(F.col(f"_n_{p}").cast("long"), F.lit(0)).alias(f"count_{p}"),
        ]
    return grouped.select("Entity", "Entity_Type", *stats, f"sample_{key}", *polarity_columns)
