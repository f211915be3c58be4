"""Quality rules as weak supervision: rules vote or abstain, EM weighs the rules, a posterior decides.

Each rule looks at one number of a text and votes ``good``, ``bad`` or abstains. How far a vote is to be
believed is not set by hand: expectation-maximisation over the counts of vote patterns of the whole corpus
estimates for every rule how often it casts each vote on good texts and on each kind of bad ones. Bad texts come in
kinds that hardly overlap (tables of marks, shouting, repetition), so there is a kind for every rule, of texts on
which this rule votes ``bad``; what the other rules do there is learned. A ``bad`` vote without the company that
it has in its kind is outvoted. Copies of a text are one text in the counts. The patterns (three votes to the power
of the number of rules) bound what reaches the driver, whatever the size of the corpus.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newspulse.functions.rows import let
from newspulse.llm.common import SPACES, free_name, ref, text_udf
from newspulse.session import stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Words among which different ones are counted; their share falls with the length of any text.
VOCABULARY = 1000
MIN_WORDS = 20
REPEAT_PERCENT = 30
GOOD, ABSTAIN, BAD = 1, 0, -1
# Where the fit starts: four of five texts are good, rules err on few of them and find what they are made for.
START_PRIOR, START_ERROR, START_ABSTAIN, START_HIT = 0.8, 0.02, 0.03, 0.8
STRENGTH = 20.0  # texts that the start counts for, in each class; a fixed number, so the corpus decides
MIX = np.uint64(0x9E3779B97F4A7C15)

STATS = T.StructType([
    T.StructField(name, T.LongType()) for name in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
        "n_upper", "n_exclaims", "n_same_neighbours", "n_distinct", "n_looked_at", "text_hash",
    )
])


@dataclass(frozen=True)
class Rule:
    """Votes bad at ``bad`` or beyond, good at ``good`` or before, abstains between; ``low`` turns the scale."""

    name: str
    over: str
    under: str
    good: float
    bad: float
    low: bool = False
    times: float = 1.0

    def vote(self, stats: Column) -> Column:
        value = stats[self.over] * F.lit(self.times)
        size = stats[self.under]
        past = (lambda x: value <= size * F.lit(x)) if self.low else (lambda x: value >= size * F.lit(x))
        before = (lambda x: value >= size * F.lit(x)) if self.low else (lambda x: value <= size * F.lit(x))
        return (
            F.when(size == 0, F.lit(ABSTAIN)).when(past(self.bad), F.lit(BAD)).when(before(self.good), F.lit(GOOD))
            .otherwise(F.lit(ABSTAIN))
        )


RULES = (
    Rule("repeated windows", "n_repeat_words", "n_words", good=0.10, bad=0.30),
    Rule("repeated lines", "n_dup_lines", "n_lines", good=0.10, bad=0.40),
    Rule("symbols", "n_symbols", "n_words", good=0.02, bad=0.10),
    Rule("capitals", "n_upper", "n_letters", good=0.10, bad=0.22),
    Rule("shouting", "n_exclaims", "n_words", good=0.05, bad=0.10),
    Rule("letters", "n_letters", "word_chars", good=0.90, bad=0.80, low=True),
    Rule("same neighbours", "n_same_neighbours", "n_words", good=0.04, bad=0.10),
    Rule("vocabulary", "n_distinct", "n_looked_at", good=0.30, bad=0.12, low=True),
)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a run of ``window`` words that occurs at least twice, the first occurrence included."""
    starts = len(ids) - window + 1
    if starts < 2:
        return 0
    run = ids[:starts].copy()
    for j in range(1, window):
        run = run * MIX + ids[j:starts + j]
    order = np.argsort(run, kind="stable")
    same = run[order[1:]] == run[order[:-1]]
    hit = np.zeros(starts, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    where = np.flatnonzero(hit)
    edges[where] += 1
    edges[where + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def vocabulary(words: list[bytes], window: int = VOCABULARY) -> tuple[int, int]:
    """Different words of each of the windows that cover the text, summed, and the sum of the windows' lengths.

    Windows follow each other; the last one ends with the text and is as long as the others.
    """
    if len(words) <= window:
        return len(set(words)), len(words)
    starts = [*range(0, len(words) - window, window), len(words) - window]
    return sum(len(set(words[at:at + window])) for at in starts), window * len(starts)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers of ``STATS`` for one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        sum(map(str.isalpha, text)),
        sum(map(str.isupper, text)),
        text.count("!"),
        int((ids[1:] == ids[:-1]).sum()),
        *vocabulary(words),
        xxhash.xxh64_intdigest(raw) - 2**63,
    )


def with_stats(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name`` of the numbers of each text."""
    return docs.withColumn(name, text_udf(lambda: text_stats, STATS)(ref(text).cast("string")))


def votes(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as one number: digit i in base 3 is the vote of rule i, plus one."""
    code = F.lit(0)
    for i, rule in enumerate(rules):
        code = code + (rule.vote(stats) + F.lit(1)) * F.lit(3**i)
    return code.cast("long")


def unpack(codes: np.ndarray, n_rules: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(n_rules) % 3 - 1


@dataclass(frozen=True)
class LabelModel:
    """Classes of texts, the good ones first, then the kind of each rule: ``prior`` has the share of each class,
    ``votes`` for each class and rule the shares of the votes bad, abstain and good."""

    prior: tuple[float, ...]
    votes: tuple[tuple[tuple[float, float, float], ...], ...]

    def classes(self, cast: np.ndarray) -> np.ndarray:
        """Probabilities of the classes for each row of votes."""
        one = np.stack([cast == BAD, cast == ABSTAIN, cast == GOOD], 2).astype(float)
        log = np.log(self.prior) + np.einsum("nrv,krv->nk", one, np.log(np.array(self.votes)))
        log[:, 1:][cast != BAD] = -np.inf  # a kind holds only what its own rule finds
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        return self.classes(cast)[:, 0]


def fit(cast: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = STRENGTH) -> LabelModel:
    """Expectation-maximisation over vote patterns (rows of ``cast``) that occur ``counts`` times.

    The starting values count as ``strength`` texts in each class, however large the corpus; other rules than its
    own are held to vote on a kind as on good texts until the kind shows otherwise. A rule whose bad votes come alone
    says by itself nothing on whether it errs or finds a kind of its own. A rule that errs does so on bad texts too,
    so it starts with the least rate at which it votes ``bad`` where another rule does: lone votes of a rule that no
    kind is free of are held for errors, those of a rule that some kind never meets are believed. A text without a
    ``bad`` vote is always good.
    """
    n_rules, own = cast.shape[1], np.arange(cast.shape[1])
    one = np.stack([cast == BAD, cast == ABSTAIN, cast == GOOD], 2).astype(float)
    both = one[:, :, 0].T @ (one[:, :, 0] * counts[:, None])
    given = (both + STRENGTH * START_ERROR) / (both[own, own] + STRENGTH)  # rule by row, where the rule of the column votes bad
    given[own, own] = START_ERROR if n_rules == 1 else 1.0
    errors = given.min(1).clip(0.001, 0.5)
    start = np.tile(np.stack([errors, np.full(n_rules, START_ABSTAIN), 1 - errors - START_ABSTAIN], 1), (n_rules + 1, 1, 1))
    start[own + 1, own] = START_HIT, (1 - START_HIT) / 2, (1 - START_HIT) / 2
    prior = np.array([START_PRIOR] + [(1 - START_PRIOR) / n_rules] * n_rules)

    def model(shares: np.ndarray, votes: np.ndarray) -> LabelModel:
        return LabelModel(tuple(shares.tolist()), tuple(tuple(map(tuple, kind)) for kind in votes.tolist()))

    now = model(prior, start)
    for _ in range(rounds):
        p = now.classes(cast) * counts[:, None]
        shares = p.sum(0) + strength * prior * len(prior)
        usual = np.tile(np.array(now.votes[0]), (n_rules + 1, 1, 1))
        usual[0] = start[0]
        usual[own + 1, own] = start[own + 1, own]
        votes = np.einsum("nk,nrv->krv", p, one) + strength * usual
        now = model(shares / shares.sum(), votes / votes.sum(2, keepdims=True))
    return now


def learn(stats: DataFrame, name: str, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """Fit the label model to the vote patterns of all different texts; at most 3 to the power of the rules are collected."""
    texts = stats.select(votes(ref(name), rules).alias("code"), ref(name)["text_hash"].alias("text")).distinct()
    rows = texts.groupBy("code").count().collect()
    rows.sort(key=lambda r: r["code"])
    codes = np.array([r["code"] for r in rows], np.int64)
    return fit(unpack(codes, len(rules)), np.array([r["count"] for r in rows], float))


def failed(stats: Column) -> Column:
    """The base rules: too few words, or too large a share of them in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (stats["n_repeat_words"] * 100 > stats["n_words"] * REPEAT_PERCENT)


def posterior(stats: Column, model: LabelModel, rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability that a text is good, given the votes on its numbers; ``LabelModel.posterior`` as an expression."""
    def seen(cast: list[Column], k: int) -> Column:
        p = F.lit(model.prior[k])
        for vote, (bad, none, good) in zip(cast, model.votes[k]):
            p = p * F.when(vote == BAD, F.lit(bad)).when(vote == GOOD, F.lit(good)).otherwise(F.lit(none))
        return p if k == 0 else F.when(cast[k - 1] == BAD, p).otherwise(F.lit(0.0))

    def share(voted: Column) -> Column:
        cast = [voted[i] for i in range(len(rules))]
        good, *kinds = [seen(cast, k) for k in range(len(rules) + 1)]
        return let(F.struct(good.alias("good"), functools.reduce(Column.__add__, kinds).alias("bad")), lambda p: p["good"] / (p["good"] + p["bad"]))

    return let(F.array(*[rule.vote(stats) for rule in rules]), share)


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Numbers, base verdict, posterior and final verdict of each row of ``docs``.

    Returns ``key``, the five numbers of the base rules, ``base_failed``, ``p_good`` and ``kept``: false where the
    base rules fail, else whether the posterior reaches ``least``. Null texts count as empty and fail. Rows are
    judged one by one, so equal texts get equal verdicts and repeated rows stay repeated; an empty table gives an
    empty result. Other columns of ``docs`` are not read. The numbers are staged once for the fit and the verdict.
    """
    name = "stats"
    staged = stage(with_stats(docs.select(ref(key).alias(key), ref(text).alias("text__")), name, "text__").drop("text__"), "quality")
    model = learn(staged, name)
    s = F.col(name)
    return staged.select(
        ref(key), *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed(s).alias("base_failed"), posterior(s, model).alias("p_good"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and no others; see ``judge`` for the verdict.

    The texts are counted twice: once for the vote patterns of the corpus, once on the way out. Staging the rows with
    their numbers instead took over 3000 MB of an executor's memory in the stage after.
    """
    name = free_name(docs, "stats")
    scored = with_stats(docs, name, text)
    model = learn(with_stats(docs.select(ref(text).alias("text__")), "stats", "text__"), "stats")
    s = ref(name)
    return scored.where(~failed(s) & (posterior(s, model) >= least)).drop(name)
