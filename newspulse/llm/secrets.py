"""Secret scans with DataFrame functions only: fixed patterns, and a randomness test battery for other keys.

The battery looks at long tokens whose characters fit an encoding of random bytes (hexadecimal and base32 in
either case, letters of one or both cases with digits, base64). Three tests ask whether a token could be random in its alphabet: chi-squared on the
counts of characters, runs above and below the middle of the alphabet, and serial correlation of neighbours.
Their combined p-value is small for words, names and numbers that count up, and the share of tokens of like length that may be
taken for ordinary although random is held down by false-discovery control over the whole corpus: within a
length class, the Benjamini-Hochberg step over all its tokens says which are ordinary; the others are secrets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.functions.rows import let
from newspulse.llm.common import free_name, ref
from newspulse.session import stage

# Fixed patterns of the base scan.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# Alphabets in the order of their values, the smallest first; the first that holds all characters of a token is
# its encoding. Hexadecimal is read without case, so letters of mixed case are no alphabet of their own.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
FOLDED = "^[0-9A-Fa-f]+$"
ENCODINGS = (
    ("hex", FOLDED, DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base32 lower", "^[a-z2-7]+$", LOWER + "234567"),
    ("base36", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("base36 lower", "^[a-z0-9]+$", DIGITS + LOWER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
# Lower ends of the length classes within which discoveries are controlled.
CLASSES = (20, 24, 32, 48, 64, 128)
BINS = 2000
DISCOVERY = 0.01


def found(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Matches of ``pattern`` as structs (start, end, kind, token), in code points, end exclusive.

    Matches and the pieces between them alternate, so a place is the length of all before it.
    """
    def placed(parts: Column) -> Column:
        hits, gaps = parts["hits"], parts["gaps"]
        pair = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g")))
        none = F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>")

        def add(acc: Column, x: Column) -> Column:
            return let(acc["at"] + x["g"], lambda start: F.struct(
                (start + F.length(x["h"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    start.alias("start"), (start + F.length(x["h"])).alias("end"), F.lit(kind).alias("kind"), x["h"].alias("token"),
                ))).alias("out")))
        return F.aggregate(pair, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda a: a["out"])

    none = F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>")
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    spans = F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)
    return F.filter(spans, keep) if keep else spans


def long_value(span: Column) -> Column:
    return F.length(F.regexp_extract(span["token"], ASSIGN, 2)) >= 12


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, by start and then in the order of ``KINDS``."""
    every = F.concat(found(text, ASSIGN, "assign", long_value), found(text, ACCESS, "access"), found(text, HEX, "hex"))
    return in_order(every)


def in_order(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "random")) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, by the approximation of Zelen and Severo."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-300))


def p_random(token: Column) -> Column:
    """Combined p-value of the three tests that a token is random in its encoding; null for a token not tested.

    Not tested are tokens without an encoding, a digit or two letters: long words and names of letters alone are
    hard to tell from random letters. Of random keys this leaves out (54/64)^n in base64, (26/32)^n in base32,
    (26/36)^n with letters of one case and digits, and all keys of letters alone; README has the rates.

    Chi-squared by the Wilson-Hilferty cube root, runs and serial correlation by their normal limits, combined
    by Fisher's method (chi-squared with six degrees, whose tail has a closed form).
    """
    body = F.regexp_replace(token, "=+$", "")
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z].*[A-Za-z]")
    choice = F.lit(None).cast("string")
    for _, pattern, alphabet in reversed(ENCODINGS):
        choice = F.when(body.rlike(pattern), F.lit(alphabet)).otherwise(choice)

    def tests(x: Column) -> Column:
        n, size = x["n"].cast("double"), F.length(x["alphabet"]).cast("double")
        counts = F.transform(F.split(x["alphabet"], ""), lambda c: x["n"] - F.length(F.replace(x["body"], c)))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        chi = squares * size / n - n
        free = size - 1
        chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        codes = F.transform(F.split(x["body"], ""), lambda c: F.instr(x["alphabet"], c).cast("double") - 0.5 - size / 2)

        def sequence_tests(v: Column) -> Column:
            pairs = F.zip_with(F.slice(v, F.lit(1), x["n"] - 1), F.slice(v, F.lit(2), x["n"] - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            turns = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when((p["a"] > 0) != (p["b"] > 0), 1.0).otherwise(0.0))
            product = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"] * p["b"])
            variance = (size * size - 1) / 12
            runs_z = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
            serial_z = product / (variance * F.sqrt(n - 1))
            p = [_normal_tail(chi_z), 2 * _normal_tail(F.abs(runs_z)), 2 * _normal_tail(F.abs(serial_z))]
            half = -(F.ln(p[0]) + F.ln(F.least(p[1], F.lit(1.0))) + F.ln(F.least(p[2], F.lit(1.0))))
            return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

        return let(codes, sequence_tests)

    folded = F.when(body.rlike(FOLDED), F.upper(body)).otherwise(body)
    ready = F.struct(folded.alias("body"), F.length(body).alias("n"), choice.alias("alphabet"))
    return F.when(mixed & choice.isNotNull(), let(ready, tests))


def length_class(span: Column) -> Column:
    length = span["end"] - span["start"]
    out = F.lit(0)
    for i, least in enumerate(CLASSES):
        out = F.when(length >= least, i).otherwise(out)
    return out


def tail_bin(p: Column) -> Column:
    """Bin of a p-value on a logarithmic scale, 100 bins a decade; the smallest are in bin 0. Null for null."""
    return F.when(p.isNotNull(), F.greatest(F.floor(F.lit(BINS) + F.log10(F.greatest(p, F.lit(1e-300))) * 100), F.lit(0)).cast("int"))


def candidates(text: Column, base: Column) -> Column:
    """Tokens outside the base spans that have an encoding, with ``cls`` and ``bin`` of their combined p-value."""
    free = F.filter(found(text, TOKEN, "random"), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    tested = F.transform(free, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["token"].alias("token"),
        length_class(s).alias("cls"), tail_bin(p_random(s["token"])).alias("bin")))
    return F.filter(tested, lambda s: s["bin"].isNotNull())


def ordinary_below(tokens: DataFrame, rate: float = DISCOVERY) -> dict[int, int]:
    """Per length class the bin below which tokens are ordinary: Benjamini-Hochberg over all tokens of the class.

    ``tokens`` has cls and bin; at most bins times classes rows of counts reach the driver.
    """
    rows = tokens.groupBy("cls", "bin").count().collect()
    cuts = {}
    for cls in range(len(CLASSES)):
        bins = sorted((r["bin"], r["count"]) for r in rows if r["cls"] == cls)
        total, seen, cut = sum(n for _, n in bins), 0, 0
        for b, n in bins:
            seen += n
            if 10 ** ((b + 1 - BINS) / 100) <= rate * seen / total:
                cut = b + 1
        # Alone among random tokens, an ordinary one still needs this much to be seen as such.
        cuts[cls] = max(cut, BINS + round(100 * math.log10(rate / 10)))
    return cuts


def secrets_among(tested: Column, cuts: dict[int, int]) -> Column:
    least = F.create_map(*[F.lit(x) for c, b in cuts.items() for x in (c, b)])
    hits = F.filter(tested, lambda s: s["bin"] >= least[s["cls"]])
    return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["token"].alias("token")))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans of each row of ``docs``: key, ``base`` and ``spans`` (base and random ones), arrays of structs in order.

    Null and empty texts have none; equal texts have equal spans; repeated rows stay repeated; other columns
    are not read. What is found in the texts is staged, without the texts, between the count of p-values over
    the corpus and the verdict.
    """
    body = F.coalesce(ref(text).cast("string"), F.lit(""))
    based = docs.select(ref(key).alias("key__"), body.alias("text__")).withColumn("base", base_spans(F.col("text__")))
    staged = stage(based.select("key__", "base", candidates(F.col("text__"), F.col("base")).alias("tested")), "secrets")
    cuts = ordinary_below(staged.select(F.explode("tested").alias("t")).select("t.cls", "t.bin"))
    both = in_order(F.concat("base", secrets_among(F.col("tested"), cuts)))
    return staged.select(F.col("key__").alias(key), "base", both.alias("spans"))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark`` (overlapping ones by one), and ``n_chars`` kept true.

    Rows and columns stay as they are otherwise; null texts stay null. ``n_chars`` is touched only where a text changed.
    """
    body = F.coalesce(ref(text).cast("string"), F.lit(""))
    base, tested, spans = (free_name(docs, n) for n in ("base", "tested", "spans"))
    alone = docs.select(body.alias("t")).withColumn("b", base_spans(F.col("t"))).select(F.explode(candidates(F.col("t"), F.col("b"))).alias("x"))
    cuts = ordinary_below(alone.select("x.cls", "x.bin"))
    named = docs.withColumn(base, base_spans(body)).withColumn(tested, candidates(body, ref(base)))
    named = named.withColumn(spans, in_order(F.concat(ref(base), secrets_among(ref(tested), cuts))))

    def cut(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(
                acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"))

    clean = F.aggregate(
        ref(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut,
        lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    hit = F.size(ref(spans)) > 0
    out = named.withColumn(text, F.when(hit, clean).otherwise(ref(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(hit, F.length(ref(text)).cast(docs.schema[n_chars].dataType)).otherwise(ref(n_chars)))
    return out.select(*[ref(c) for c in docs.columns])
