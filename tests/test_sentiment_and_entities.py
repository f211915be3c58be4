"""Lexicon sentiment (N1-N6), entities (E1-E12), their statistics, and the end-to-end flows."""

from decimal import Decimal
from statistics import mean, variance

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newspulse.operators import entities as E
from newspulse.operators import sentiment as N
from newspulse.plans import articles, feed, news
from newspulse.resources import lexicon as L
from newspulse.resources import words


@pytest.fixture(scope="module")
def lex(spark):
    return L.lexicon(spark).cache()


@pytest.fixture(scope="module")
def gaz(spark):
    return words.gazetteer(spark).cache()


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, t string")


def compounds(spark, lex, *rows):
    got = N.compound(texts(spark, *rows), ["id"], "t", lex).collect()
    return [r for r in sorted(got, key=lambda r: r.id)]


def test_mean_valence(spark, lex):
    got = N.mean_valence(texts(spark, "Good, GOOD war", "nothing", None, ""), ["id"], "t", lex).orderBy("id").collect()
    assert [(r.hits, r.sentiment) for r in got] == [(3, pytest.approx(0.2, rel=1e-15)), (0, 0.0), (0, 0.0), (0, 0.0)]


def test_opposite_sentences_have_opposite_signs(spark, lex):
    got = N.mean_valence(texts(spark, "A dreadful day for the harbour", "A brilliant day for the harbour"), ["id"], "t", lex).orderBy("id").collect()
    assert got[0].sentiment < 0 < got[1].sentiment


def test_polarity_negation_halves_and_turns(spark, lex):
    rows = N.polarity(texts(spark, "good", "not good", "good bad", "x", None), ["id"], "t", lex).orderBy("id").collect()
    assert [float(r.polarity) for r in rows] == [0.475, -0.2375, 0.0, 0.0, 0.0]
    assert [r.polarity_label for r in rows] == ["positive", "negative", "neutral", "neutral", "neutral"]
    assert float(rows[0].subjectivity) == 0.575


def test_labels_come_from_the_exact_sum(spark):
    tiny = L.lexicon(spark, [("tiny", "1.0", "0.001", "0.5", "valence"), ("plain", "1.0", "0.000", "0.5", "valence")])
    rows = N.polarity(texts(spark, "tiny" + " plain" * 3000, "plain"), ["id"], "t", tiny).orderBy("id").collect()
    assert [(r.polarity, r.polarity_label) for r in rows] == [(0.001 / 3001, "positive"), (0.0, "neutral")]


def normal(s):
    return round(s / (s * s + 15) ** 0.5, 4)


def test_compound_rules(spark, lex):
    good, bad = 1.9, -1.9
    cases = {
        "good day": good,
        "very good day": good + 0.293,
        "slightly good": good - 0.293,
        "very bad": bad - 0.293,
        "very plain good": good + 0.293 * 0.95,
        "very plain old good": good + 0.293 * 0.9,
        "very one two three good": good,
        "not good": good * -0.74,
        "not very good": (good + 0.293) * -0.74,
        "very not good": good * -0.74 - 0.293 * 0.95,
        "not a b c good": good,
        "GOOD day": good + 0.733,
        "GOOD DAY": good,
        "good but bad": good * 0.5 + bad * 1.5,
        "good!!": good + 2 * 0.292,
        "good!!!!!!": good + 4 * 0.292,
        "good??": good + 0.36,
        "good?": good,
        "bad????": bad - 0.96,
        "plain": 0.0,
        "": 0.0,
    }
    got = compounds(spark, lex, *cases)
    for row, (text, s) in zip(got, cases.items()):
        assert row.compound == pytest.approx(normal(s), abs=1e-9), text


def test_compound_shares_and_missing_text(spark, lex):
    one, missing = compounds(spark, lex, "good day bad", None)
    up, down = 1.9 + 1, 1.9 + 1
    total = up + down + 1
    assert (one.pos, one.neg, one.neu) == (round(up / total, 3), round(down / total, 3), round(1 / total, 3))
    assert (missing.compound, missing.pos, missing.sentiment_text) == (None, None, "neutral")


def test_long_text_scores_in_linear_space(spark, lex):
    row = compounds(spark, lex, "plain good bad " * 20_000)[0]
    assert row.compound == pytest.approx(0.0) and row.neu == pytest.approx(round(20_000 / (20_000 + 2 * 58_000), 3))


def test_texts_without_white_space_do_not_exhaust_the_stack(spark, lex, gaz):
    df = texts(spark, "a'" * 200_000, "b." * 200_000, "c-" * 200_000)
    assert N.mean_valence(df, ["id"], "t", lex).count() == 3
    assert [r.neu for r in N.compound(df, ["id"], "t", lex).collect()] == [1.0, 1.0, 1.0]
    assert E.mention_lists(df, "id", "t", gaz).count() == 0


def test_scores_struct_round_trip(spark, lex):
    scored = N.compound(texts(spark, "good"), ["id"], "t", lex)
    again = N.expand_scores(N.score_struct(scored))
    assert set(again.columns) == set(scored.columns) and again.first().compound == scored.first().compound


def test_multi_column(spark, lex):
    df = spark.createDataFrame([(1, "good", None), (2, "x", "bad")], "id int, title_clean string, content_clean string")
    got = {r.id: r for r in N.polarities(df, ["id"], ["title_clean", "content_clean"], lex).collect()}
    assert got[1].title_clean_polarity_label == "positive" and got[1].content_clean_polarity_label == "neutral"
    assert got[2].content_clean_polarity_label == "negative"


def test_own_scorer(spark):
    @F.pandas_udf("double")
    def scorer(s: pd.Series) -> pd.Series:
        return s.str.len().astype(float)

    assert N.score_with(texts(spark, "abcd"), "t", scorer).first().scores == 4.0


def found(spark, gaz, *rows):
    lists = E.mention_lists(texts(spark, *rows), "id", "t", gaz)
    return {r.id: [(m.pos, m.text, m.label) for m in r.entities] for r in lists.collect()}


def test_longest_match_wins(spark, gaz):
    got = found(spark, gaz, "From New York City to New York Times, Google.", "none", None, "New, York", "apple Apple")
    assert got == {
        0: [(1, "New York City", "LOC"), (5, "New York Times", "ORG"), (9, "Google", "ORG")],
        4: [(0, "apple", "ORG"), (1, "Apple", "ORG")],
    }


def test_overlap_is_settled_from_the_left(spark):
    gaz = words.gazetteer(spark, [("a b", "X"), ("b c", "Y"), ("c", "Z")])
    assert found(spark, gaz, "a b c b c") == {0: [(0, "a b", "X"), (2, "c", "Z"), (3, "b c", "Y")]}


def test_pattern_mentions(spark):
    got = E.pattern_mentions(texts(spark, "x a@b.dk y c@d.dk"), "id", "t", {"EMAIL": r"[a-z]@[a-z.]+"}).collect()
    assert [(r.ordinal, r.text, r.label) for r in got] == [(0, "a@b.dk", "EMAIL"), (1, "c@d.dk", "EMAIL")]


def lists_of(spark, *rows):
    schema = "doc_id int, medie string, c double, t double, entities array<struct<pos:int,text:string,label:string>>"
    df = spark.createDataFrame(list(rows), schema)
    return df.withColumn("sentiment_content", F.col("c").cast("decimal(18,6)")).withColumn(
        "sentiment_title", F.col("t").cast("decimal(18,6)")
    )


ROWS = [
    (1, "EB", 1.0, None, [(0, "Lars Løkke", "PER"), (3, "Lars Løkke", "PER"), (5, "F.C. \"K\"-1", "ORG")]),
    (2, "EB", 3.0, 1.0, [(0, "LARS LØKKE", "ORG")]),
    (3, "DR", 5.0, 2.0, [(0, "Lars Løkke", "PER")]),
]


def test_entity_strings_keys_and_types(spark):
    df = lists_of(spark, *ROWS)
    assert df.select(E.entity_string("entities")).first()[0] == "Lars Løkke,Lars Løkke,FC  K 1"
    types = {r.entity: r.entity_type for r in E.entity_types(df, "doc_id").collect()}
    assert types == {"larsløkke": "PER", "fck1": "ORG"}
    swapped = {r.entity: r.entity_type for r in E.entity_types(df.where("doc_id < 3"), "doc_id").collect()}
    assert swapped["larsløkke"] == "ORG"  # the last mention decides


def test_entity_counts_and_totals(spark):
    df = lists_of(spark, *ROWS)
    counts = {(r.doc_id, r.term): r.n for r in E.entity_counts(df, "doc_id").collect()}
    assert counts[(1, "lars")] == 2 and counts[(1, "fc")] == 1 and (1, "k") not in counts
    totals = {(r.medie, r.term): r.n for r in E.entity_totals(df).collect()}
    assert totals[("EB", "løkke")] == 3 and totals[("DR", "løkke")] == 1


def test_entity_sentiment_counts_each_article_once(spark):
    stats = {(r.medie, r.entity): r for r in E.entity_sentiment(lists_of(spark, *ROWS)).collect()}
    eb = stats[("EB", "larsløkke")]
    assert (float(eb.average_sentiment), eb["count"], float(eb.average_sentiment_title), eb.count_title) == (2.0, 2, 1.0, 1)
    assert stats[("EB", "fck1")].average_sentiment_title is None


def test_token_units_of_multi_word_names_find_no_type(spark):
    df = lists_of(spark, *ROWS)
    types = E.entity_types(df, "doc_id")
    tokens = E.attach_types(E.entity_sentiment(df, unit="token"), types)
    assert {r.entity_type for r in tokens.where("entity = 'lars'").collect()} == {None}
    whole = E.attach_types(E.entity_sentiment(df, unit="mention"), types)
    assert {r.entity_type for r in whole.where("entity = 'larsløkke'").collect()} == {"PER"}


def brute_polarity(rows, pairing):
    groups = {}
    for doc, p, ents in rows:
        pairs = [(t, l) for t, l in ents] if pairing == "zip" else [(t, l) for t, _ in ents for _, l in ents]
        for pair in pairs:
            groups.setdefault(pair, []).append((doc, p))
    out = {}
    for pair, values in groups.items():
        ps = [p for _, p in values if p is not None]
        first = min(values)[0]
        out[pair] = (
            mean(ps) if ps else None, variance(ps) if len(ps) > 1 else None, len(ps), first,
        )
    return out


@pytest.mark.parametrize("pairing", ["zip", "cross"])
def test_entity_polarity_against_brute_force(spark, pairing):
    data = [
        (1, 0.25, [("A", "X"), ("B", "Y"), ("A", "X"), ("C", "Y")]),
        (2, -0.5, [("A", "Y")]), (3, None, [("A", "X"), ("D", "Z")]), (4, 0.125, [("B", "Y"), ("A", "X")]),
    ]
    rows = [(d, None if p is None else Decimal(str(p)), [(i, t, l) for i, (t, l) in enumerate(e)]) for d, p, e in data]
    df = spark.createDataFrame(rows, "doc_id int, p decimal(18,6), entities array<struct<pos:int,text:string,label:string>>")
    got = E.entity_polarity(df, "doc_id", ["p"], pairing).collect()
    want = brute_polarity(data, pairing)
    assert {(r.Entity, r.Entity_Type) for r in got} == set(want)
    for r in got:
        m, v, n, first = want[(r.Entity, r.Entity_Type)]
        assert (r.count_p, r.sample_doc_id) == (n, first)
        assert r.mean_p == (None if m is None else pytest.approx(m))
        assert r.var_p == (None if v is None else pytest.approx(v, abs=1e-9))


def test_article_flow(spark, lex, gaz):
    rows = [
        ("http://a.dk/krimi/x/1", "Good win", "Terrible crime in New York.\n12", "EB", "f1", 0),
        ("http://a.dk/krimi/x/1", "again", "dup", "EB", "f2", 0),
        ("http://a.dk/sport/2", "Bad day", "A great win for Google, Google", "DR", "f1", 1),
        ("http://a.dk/live", "Live", "", "DR", "f1", 2),
    ]
    daily = spark.createDataFrame(rows, "link string, title string, content string, medie string, Filename string, row_id long")
    tables = articles.analyse(daily, lex, gaz)
    simple = {r.link: r for r in tables.simple.collect()}
    assert set(simple) == {"http://a.dk/krimi/x/1", "http://a.dk/sport/2"}
    krimi = simple["http://a.dk/krimi/x/1"]
    assert (krimi.category_1, krimi.category_2, krimi.enti_str) == ("krimi", "x", "New York")
    assert float(krimi.sentiment_content) == -2.2 and float(krimi.sentiment_title) == 2.15
    entities = [(r.entity, r.medie, r["count"], r.entity_type) for r in tables.entities.collect()]
    assert entities == [("newyork", "EB", 1, "LOC"), ("google", "DR", 1, "ORG")]


def test_feed_flow(spark, lex):
    rows = [
        ("u1", "EUR slips", "Good news for the ECB", "20240102T000000"),
        ("u2", "Dollar up", "Terrible losses", "20240101T000000"),
        ("u3", "Dollar earnings", "profit", "20240101T000000"),
        ("u4", "USD and euro", None, "soon"),
    ]
    items = spark.createDataFrame(rows, "url string, title string, summary string, time_published string")
    done = feed.analyse(items, lex)
    got = {r.url: r for r in done.collect()}
    assert "u3" not in got and got["u4"].sentiment_text == "neutral" and got["u4"].time_published_dt is None
    assert (got["u1"].currency_topic, got["u1"].sentiment_text) == ("EUR", "positive")
    assert "u2" not in got  # a title class alone does not make an item relevant
    assert [r.currency_topic for r in feed.time_series(done).collect()] == ["EUR"]
    assert feed.table_view(done).columns == ["title", "summary", "currency_topic", "compound", "sentiment_text"]


def test_news_flow(spark, lex, gaz):
    rows = [(1, "Google wins!", "bad <b>day</b>", "good"), (2, "Google and Apple", "great", None)]
    table = spark.createDataFrame(rows, "id int, title string, description string, content string")
    done = news.analyse(table, lex, gaz)
    got = {r.id: r for r in done.collect()}
    assert got[1].title_clean == "Google wins" and got[1].description_clean_polarity_label == "negative"
    assert [m.text for m in got[2].title_clean_entities] == ["Google", "Apple"]
    stats = {r.Entity: r for r in news.entity_table(done, "id").collect()}
    assert stats["Google"].count_title_clean_polarity == 2 and stats["Apple"].sample_id == 2


def test_flows_keep_rows_with_repeated_and_missing_keys_apart(spark, lex, gaz):
    items = spark.createDataFrame(
        [("u", "EUR", "excellent great euro news"), ("u", "EUR", "terrible crisis of the ECB"), (None, "EUR", "great ECB")],
        "url string, title string, summary string",
    ).withColumn("time_published", F.lit("20240101T000000"))
    got = sorted((r.summary, r.sentiment_text) for r in feed.analyse(items, lex).collect())
    assert [label for _, label in got] == ["positive", "positive", "negative"]

    table = spark.createDataFrame([(1, "Google wins", "x", "y"), (1, "Terrible crisis", "x", "y"), (None, "Apple", "great", "y")],
                                  "id int, title string, description string, content string")
    done = news.analyse(table, lex, gaz).collect()
    assert sorted((r.title, r.title_clean_polarity_label) for r in done) == [("Apple", "neutral"), ("Google wins", "positive"), ("Terrible crisis", "negative")]

    daily = spark.createDataFrame(
        [(None, "Good", "A terrible crime in New York", "EB", "f1", 0), (None, "again", "dup text", "EB", "f1", 1)],
        "link string, title string, content string, medie string, Filename string, row_id long")
    only = articles.analyse(daily, lex, gaz).simple.collect()
    assert [(r.enti_str, r.sentiment_content < 0, r.sentiment_title > 0) for r in only] == [("New York", True, True)]
