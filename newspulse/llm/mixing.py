"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

The target of a source over its size is the number of copies each of its documents should get. The whole part
is given to all; the fraction is rounded so that the words of a source stay what they are: of two documents,
words move from one to the other, in a random direction that keeps both expectations, until one of the two is
decided, and the other goes on to meet the next. Groups of about ``fan`` documents each leave one undecided
document, those meet in the groups of the next level, and so on: a reduction tree of a source's documents.
Documents with a large share of their source come first, each against all that are still undecided, so the many
small ones take up what a large one leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newspulse.functions.rows import let
from newspulse.llm.common import free_name, ref
from newspulse.session import stage

WEIGHTS = (5, 2, 1)
CAP = 3
FAN = 64
SEED = 5
# Java matches a possessive class without keeping places to come back to.
WORDS = r"[^\x20\x09-\x0D]++"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per source: source_size, weight, target and n (units); ``units`` has source, size and many.

    Sources in code-point order, null last, take the weights in turn and share all words by weight; no target
    exceeds ``cap`` times its source's words, and the excess is shared by weight among the others until none is
    above. The shares are ``level * weight`` up to the cap, and the level is the greatest of those that arise
    when the sources that reach their cap first are taken out one by one. The windows run over the table of
    sources, a row each, not over documents.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sums.withColumn("weight", F.get(cycle, F.pmod(turn, F.lit(len(weights)))))
    most = F.col("source_size") * F.lit(float(cap))
    every = Window.partitionBy()
    earlier = Window.orderBy(most / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(most).over(earlier), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    levels = weighed.withColumn("level", left / open_weight)
    level = F.greatest(F.max("level").over(every), F.lit(0.0))
    return levels.withColumn("target", F.least(most, level * F.col("weight"))).drop("level")


def _pivot(group: Column, level: int) -> Column:
    """Fold the documents of a group (structs with words, p, id) to the decided ones and the one left over.

    ``words`` is what one more copy of the document brings, ``p`` the probability of that copy.
    """
    def draw(a: Column, b: Column) -> Column:
        mixed = F.xxhash64(F.lit(SEED), F.lit(level), a["id"], a["size"], a["hash"], b["id"], b["size"], b["hash"])
        return F.pmod(mixed, F.lit(2**52)) / F.lit(float(2**52))

    def decided(x: Column, take: int | Column) -> Column:
        return x.withField("take", F.lit(take) if isinstance(take, int) else take)

    def meet(acc: Column, b: Column) -> Column:
        a = acc["left"]

        def moves(m: Column) -> Column:
            first_up = (m["up"] > 0) & (m["u"] * (m["up"] + m["down"]) < m["down"]) | (m["down"] <= 0)
            none = (m["up"] <= 0) & (m["down"] <= 0)
            a_full, a_empty = m["up"] >= m["room_a"], m["down"] >= m["mass_a"]
            a_less = a.withField("p", F.greatest(a["p"] - m["down"] / a["words"], F.lit(0.0)))
            a_more = a.withField("p", F.least(a["p"] + m["up"] / a["words"], F.lit(1.0)))
            b_less = b.withField("p", F.greatest(b["p"] - m["up"] / b["words"], F.lit(0.0)))
            b_more = b.withField("p", F.least(b["p"] + m["down"] / b["words"], F.lit(1.0)))
            step = (
                F.when(none, F.struct(decided(a, F.when(a["p"] >= 0.5, 1).otherwise(0)).alias("out"), b.alias("left")))
                .when(first_up & a_full, F.struct(decided(a, 1).alias("out"), b_less.alias("left")))
                .when(first_up, F.struct(decided(b, 0).alias("out"), a_more.alias("left")))
                .when(a_empty, F.struct(decided(a, 0).alias("out"), b_more.alias("left")))
                .otherwise(F.struct(decided(b, 1).alias("out"), a_less.alias("left")))
            )
            return let(step, lambda s: F.struct(F.concat(acc["done"], F.array(s["out"])).alias("done"), s["left"].alias("left")))

        mass_a, mass_b = a["p"] * a["words"], b["p"] * b["words"]
        room_a, room_b = (1 - a["p"]) * a["words"], (1 - b["p"]) * b["words"]
        return let(
            F.struct(
                F.least(room_a, mass_b).alias("up"), F.least(mass_a, room_b).alias("down"),
                mass_a.alias("mass_a"), room_a.alias("room_a"), draw(a, b).alias("u"),
            ), moves)

    first = F.get(group, F.lit(0))
    start = F.struct(F.slice(group, 1, 0).alias("done"), first.alias("left"))
    return F.aggregate(F.slice(group, F.lit(2), F.greatest(F.size(group), F.lit(1))), start, meet)


def _round(units: DataFrame, fan: int) -> DataFrame:
    """``units`` (source, id, size, hash, many, p) with ``take``, 0 or 1."""
    item = F.struct("order", "id", "size", "hash", "many", (F.col("size") * F.col("many")).cast("double").alias("words"),
                    "p", F.lit(0).alias("take"))
    plain = units.where((F.col("p") <= 0) | (F.col("size") == 0)).select("source", "id", "size", "hash", "many", F.lit(0).alias("take"))
    rest = units.where((F.col("p") > 0) & (F.col("size") > 0)).withColumn("order", F.xxhash64(F.lit(SEED), "id", "size", "hash"))
    groups = F.greatest(F.ceil(F.col("n") / fan), F.lit(1)).cast("long")
    now = rest.select("source", F.pmod(F.shiftright("order", 8), groups).alias("bucket"), item.alias("x"))
    widest = units.agg(F.max(groups)).first()[0] or 1
    out, level = [plain], 0
    while True:
        folded = now.groupBy("source", "bucket").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        folded = stage(folded.select("source", "bucket", _pivot(F.col("xs"), level).alias("f")), "pivots")
        out.append(folded.select("source", F.explode("f.done").alias("x")).select("source", *[F.col(f"x.{c}") for c in ("id", "size", "hash", "many", "take")]))
        if widest <= 1:
            break
        now = folded.select("source", F.floor(F.col("bucket") / fan).cast("long").alias("bucket"), F.col("f.left").alias("x"))
        widest, level = math.ceil(widest / fan), level + 1
    last = folded.select("source", F.col("f.left").alias("x"))
    u = F.pmod(F.xxhash64(F.lit(SEED), F.lit(-1), "x.id", "x.size", "x.hash"), F.lit(2**52)) / F.lit(float(2**52))
    out.append(last.select("source", "x.id", "x.size", "x.hash", "x.many", F.when(u < F.col("x.p"), 1).otherwise(0).alias("take")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _heavy(units: DataFrame, fan: int) -> DataFrame:
    """Decide the units with more than one in ``fan`` of the words of their source, fewer than ``fan`` a source.

    ``units`` has source, source_size, id, size, hash, many and p, the same for all of a source. One after the other,
    largest first, a unit moves words to or from all that are undecided until it is, up with probability p; where the
    others cannot take or give so much in one direction it is the other one, where in neither, the nearer one.
    Returns source, done (structs with take) and p, what is left for each of the others.
    """
    words = (F.col("size") * F.col("many")).cast("double")
    item = F.struct((-words).alias("order"), F.xxhash64(F.lit(SEED), "id", "size", "hash").alias("draw"), "id", "size", "hash", "many")
    large = units.where((F.col("p") > 0) & (words * fan > F.col("source_size")))
    large = large.groupBy("source", "source_size", "p").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def decide(acc: Column, x: Column) -> Column:
        size, rest = -x["order"], acc["words"] + x["order"]
        u = F.pmod(F.xxhash64(F.lit(SEED), F.lit(-2), x["draw"]), F.lit(2**52)) / F.lit(float(2**52))
        over, under = size - acc["mass"], acc["mass"] - rest  # missed by if taken, by if not
        take = F.when((over <= 0) & (under <= 0), u * acc["words"] < acc["mass"]).otherwise(F.greatest(over, F.lit(0.0)) < F.greatest(under, F.lit(0.0)))
        return let(take, lambda t: F.struct(
            F.concat(acc["done"], F.array(F.struct(
                x["id"].alias("id"), x["size"].alias("size"), x["hash"].alias("hash"), x["many"].alias("many"), t.cast("int").alias("take")))).alias("done"),
            rest.alias("words"), F.least(F.greatest(acc["mass"] - F.when(t, size).otherwise(0.0), F.lit(0.0)), rest).alias("mass")))

    none = F.transform(F.slice("xs", 1, 0), lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["hash"].alias("hash"), x["many"].alias("many"), F.lit(0).alias("take")))
    total = F.col("source_size").cast("double")
    folded = F.aggregate("xs", F.struct(none.alias("done"), total.alias("words"), (total * F.col("p")).alias("mass")), decide)
    left = F.when(F.col("f.words") > 0, F.col("f.mass") / F.col("f.words")).otherwise(0.0)
    return large.select("source", folded.alias("f")).select("source", "f.done", left.alias("p"))


def decisions(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, fan: int = FAN,
    text: str = "text", key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """Copies of each distinct (key, source, text): source, id, size, hash, many (such rows), source_size, target, copies.

    Rows alike in all three share one decision and count together. Null texts have size 0 and, like any text
    without words, get the whole part of their source's copies; null keys and sources are values like others. A
    source comes within one small unit of its target, one of at most its words over ``fan``, unless a single unit is
    too large for the others to make up for.
    """
    rows = docs.select(
        ref(source).alias("source"), ref(key).alias("id"), n_words(ref(text)).alias("size"), F.xxhash64(ref(text)).alias("hash"))
    units = stage(rows.groupBy("source", "id", "size", "hash").agg(F.count("*").alias("many")), "units")
    targets = stage(source_targets(units, weights, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    named = units.join(targets, units["source"].eqNullSafe(targets["source"])).select(
        units["source"], "id", "size", "hash", "many", "n", "source_size", F.greatest(ratio - whole, F.lit(0.0)).alias("p"))
    named = named.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    heavy = stage(_heavy(named, fan), "heavy")
    after = heavy.select(F.col("source").alias("of"), F.col("p").alias("left"))
    light = named.join(after, F.col("source").eqNullSafe(F.col("of")), "left").where(
        (F.col("p") <= 0) | (F.col("size") * F.col("many") * fan <= F.col("source_size")))
    left = F.coalesce("left", "p")
    light = light.withColumn("p", F.when(left < 1e-9, 0.0).otherwise(F.least(left, F.lit(1.0)))).drop("of", "left")
    decided = heavy.select("source", F.explode("done").alias("x")).select("source", "x.*")
    taken = _round(light, fan).unionByName(decided)
    out = taken.join(targets, taken["source"].eqNullSafe(targets["source"]))
    return out.select(
        taken["source"], "id", "size", "hash", "many", "source_size", "target",
        (whole + F.col("take")).cast("long").alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """Per row of ``docs``: key, size, source_size, target and taken, the words the mix takes of it with repeats.

    See ``source_targets`` and ``decisions`` for the rules; every run decides alike. No row is taken more often
    than ``cap`` times. Other columns are not read; an empty table gives an empty result.
    """
    each = decisions(docs, text=text, key=key, source=source, **how)
    rows = each.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))))
    return rows.select(
        F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, with its columns unchanged."""
    made = [free_name(docs, n) for n in ("mix_source", "mix_id", "mix_hash", "mix_copies", "mix_again", "mix_text_hash")]
    of, id_, hash_, copies, again, own = made
    each = decisions(docs, text=text, key=key, source=source, **how).where("copies > 0").select(
        F.col("source").alias(of), F.col("id").alias(id_), F.col("hash").alias(hash_), F.col("copies").alias(copies))
    found = docs.withColumn(own, F.xxhash64(ref(text))).join(
        each, ref(key).eqNullSafe(ref(id_)) & (ref(own) == ref(hash_)) & ref(source).eqNullSafe(ref(of)))
    times = F.explode(F.sequence(F.lit(1).cast("long"), ref(copies))).alias(again)
    return found.select(*[ref(c) for c in docs.columns], times).drop(again)
