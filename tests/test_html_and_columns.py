"""HTML extraction (H1-H11), scalar columns and filters (P1-P20), cleaning (T1-T9), geometry."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from newspulse.functions import columns as C
from newspulse.functions import html as H
from newspulse.functions import text as X
from newspulse.operators import filters, geometry, reports, tokens
from newspulse.operators import html as O
from newspulse.plans.pages import gather
from newspulse.resources import patterns, words


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


BODY = '<div class="article-bodytext"><p>Et &amp; to&nbsp;tre</p><div>indre <b>dyb</b></div><script>no()</script> slut</div>'


def page(body, title='<h1 class="art-title"> Over\nskrift </h1>'):
    return f"<html><head><style>p{{}}</style></head><body>{title}<!-- c -->{body}<p>efter</p></body></html>"


def test_nested_regions_per_site(spark):
    rows = [
        ("l1", "EB", page(BODY)),
        ("l2", "EB", page("<div class='other'>x</div>")),  # no body: not an article
        ("l3", "EB", page(BODY, title="<h2>x</h2>")),  # no headline
        ("l4", "TV2", page('<div class="tc_page__body big">br<br>ud</div>')),
        ("l5", "XX", page(BODY)),
    ]
    got = O.nested_regions(spark.createDataFrame(rows, "link string, medie string, html string")).collect()
    assert {r.link: (r.title, r.content) for r in got} == {
        "l1": (" Over skrift ", "Et & to treindre dyb slut"),
        "l4": (" Over skrift ", "brud"),
    }


def test_class_selector_matches_one_class_or_the_whole_attribute(spark):
    html = '<div class="a b">x</div><div class="b c">y</div>'
    pick = lambda cls: one(spark, html, lambda c: H.first_text(c, "div", cls))
    assert (pick("b"), pick("b c"), pick("c"), pick("d")) == ("x", "y", "y", None)


def test_entities_numeric_and_named(spark):
    assert one(spark, "&#230;&oslash;&#229; &#8364; &amp;lt; &unknown;", H.decode_entities) == "æøå € &lt; &unknown;"


def test_flat_articles_keep_link_with_its_page(spark):
    rows = [("http://h.dk/1", "<h1>A</h1><article>a</article>"), ("http://h.dk/2", "<h1>B</h1>"), ("http://h.dk/3", "<h1>C</h1><article>c</article>")]
    got = O.page_articles(spark.createDataFrame(rows, "url string, html string")).collect()
    assert {(r.link, r.title, r.content, r.medie) for r in got} == {
        ("http://h.dk/1", "A", "a", "h.dk"), ("http://h.dk/3", "C", "c", "h.dk"),
    }


def test_site_links_all_rules(spark):
    rows = [
        ("TV2", '<article><a href="u0">l</a></article><article class="z"><a href="u1">l</a></article>'),
        ("BT", '<article class="teaser teaser--flat cat-news"><a data-lpurl="b0"></a></article>'
               '<article class="teaser teaser--flat cat-news"><a href="q" data-lpurl="b1"></a></article>'
               '<article class="other"><a data-lpurl="b2"></a></article>'),
        ("DR", '<div class="dre-teaser"><a href="/nyheder/1"></a></div>'),
        ("EB", '<article data-priority="A+"><a href="/paid"></a></article><article><a href="/none"></a></article>'
               '<article data-priority="B"><a href="/free"></a></article>'),
    ]
    got = O.site_links(spark.createDataFrame(rows, "medie string, html string")).collect()
    assert {(r.medie, r.link) for r in got} == {
        ("TV2", "u1"), ("BT", "b1"), ("DR", "https://dr.dk//nyheder/1"), ("EB", "https://ekstrabladet.dk/free"),
    }


def test_zip_lists_pads_with_null(spark):
    df = spark.createDataFrame([(1, "<h2>a</h2><h2>b</h2><p>x</p>")], "id int, html string")
    got = O.zip_lists(df, ("title", H.all_texts(F.col("html"), "h2")), ("content", H.all_texts(F.col("html"), "p"))).collect()
    assert [(r.pos, r.title, r.content) for r in got] == [(0, "a", "x"), (1, "b", None)]


def test_gather_links_pages_and_listed_articles(spark):
    short = "hydra-latest-news-page-short-news"
    fronts = [
        ("EB", '<article data-priority="B"><a href="/1"></a></article><article data-priority="B"><a href="/1"></a></article>'),
        ("DR", f'<div class="dre-teaser"><a href="n/1"></a></div><article class="{short}">'
               f'<h2 class="{short}__title dre-variables">T1</h2>tekst</article><article class="{short}">mere</article>'),
    ]
    pages = [("https://ekstrabladet.dk/1", page(BODY)), ("https://ekstrabladet.dk/2", page(BODY))]
    got = gather(
        spark.createDataFrame(fronts, "medie string, html string"), spark.createDataFrame(pages, "url string, html string")
    ).collect()
    assert sorted(((r.link, r.title, r.content, r.medie) for r in got), key=str) == sorted([
        ("https://ekstrabladet.dk/1", " Over skrift ", "Et & to treindre dyb slut", "EB"),
        ("https://dr.dk/n/1", "T1", "T1tekst", "DR"), (None, None, "mere", "DR"),
    ], key=str)


def test_with_text_needs_two_characters(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("ab",)], "content string")
    assert [r.content for r in filters.with_text(df).collect()] == ["ab"]


def test_placeholder_keeps_null_title(spark):
    df = spark.createDataFrame([(None,), ("[Removed]",), ("x",)], "title string")
    assert {r.title for r in filters.drop_placeholder(df).collect()} == {None, "x"}


def test_from_sources_list_and_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "source_id string")
    assert [r[0] for r in filters.from_sources(df, ["a"]).collect()] == ["a"]
    assert [r[0] for r in filters.from_sources(df, df.where("source_id = 'b'")).collect()] == ["b"]


def test_has_attribute(spark):
    df = spark.createDataFrame([(None,), ("A+",), ("B",)], "a string")
    assert [r.a for r in filters.has_attribute(df, F.col("a"), "A+").collect()] == ["B"]


def test_concat_strict_and_join_present(spark):
    df = spark.createDataFrame([("A", None), (None, "B"), ("A", "B")], "title string, summary string")
    strict = [r[0] for r in df.select(X.concat_strict("title", "summary")).collect()]
    present = [r[0] for r in df.select(X.join_present(["title", "summary", "nope"], df.columns)).collect()]
    assert strict == [None, None, "A B"] and present == ["a", "b", "a b"]


@pytest.mark.parametrize("text,keep", [
    ("ECB holds rates", True),
    ("Quarterly results beat, euro up", False),
    ("Analyst downgrade lifts dollar index", False),
    ("Analyst downgrades as euro falls", False),
    ("Bitcoin rallies while the Fed waits", False),
    ("Euro stablecoin and bitcoin: the ECB view", True),
    ("crypto-euro plan of the ECB", True),
    ("Crypto and the Fed", False),
    ("EUR / USD slips", True), ("greenback firm", True), ("Dollar Index DXY", True), ("FXE inflows", True),
    ("nfp tomorrow", True), ("Tariffs on steel", True), ("geopolitical risk", True), ("MiCA rules", True),
    ("Local football", False), ("Q3 2024 outlook for the euro", False), ("euro area data", True),
])
def test_topical_filter_with_real_wording(spark, text, keep):
    df = spark.createDataFrame([(text, None)], "title string, summary string")
    assert (filters.topical(df, patterns.EURUSD_NEWS).count() == 1) is keep


@pytest.mark.parametrize("title,label", [
    ("US dollars gain", "USD"), ("Greenback falls", "USD"), ("Single currency up", "EUR"), ("Euros", "EUR"),
    ("EUR against USD", "Both"), ("eurozone and the dollar", "Both"), ("Gold", "Other"), (None, "Other"),
    ("eurovision", "Other"), ("king  dollar", "USD"), ("us.dollar", "USD"),
])
def test_currency_class(spark, title, label):
    assert one(spark, title, lambda c: filters.two_way_class(c, patterns.CURRENCIES)) == label


def test_labels(spark):
    p = [one(spark, v, C.polarity_label, "double") for v in (-0.1, 0.0, 0.2, None)]
    c = [one(spark, v, C.compound_label, "double") for v in (0.05, 0.049, -0.05, -0.049, None)]
    assert p == ["negative", "neutral", "positive", "neutral"]
    assert c == ["positive", "neutral", "negative", "neutral", "neutral"]


@pytest.mark.parametrize("link,segments", [
    ("https://a.dk", []), ("https://a.dk/", []), ("https://a.dk/x", []), ("https://a.dk/x/y", ["x"]),
    ("https://a.dk/x/y/z", ["x", "y"]), ("https://dr.dk//nyheder/ind/1", ["nyheder", "ind"]),
    ("https://a.dk/x/y/", ["x", "y"]), ("rel", []),
])
def test_link_segments(spark, link, segments):
    assert one(spark, link, C.link_segments) == segments
    assert one(spark, link, lambda c: C.link_category(c, 0)) == (segments[0] if segments else None)


def test_timestamps(spark):
    assert one(spark, "2022-02-27T10:11:12Z", C.iso_timestamp) == datetime(2022, 2, 27, 10, 11, 12)
    assert one(spark, "20220227T101112", C.compact_timestamp) == datetime(2022, 2, 27, 10, 11, 12)
    assert one(spark, "27.02.2022", C.compact_timestamp) is None


@pytest.mark.parametrize("born,today,age", [
    (date(2004, 2, 29), date(2023, 2, 28), 18), (date(2004, 2, 29), date(2023, 3, 1), 19),
    (date(2000, 5, 5), date(2020, 5, 5), 20), (date(2000, 5, 6), date(2020, 5, 5), 19),
])
def test_age(spark, born, today, age):
    assert one(spark, born, lambda c: C.age_years(c, F.lit(today)), "date") == age


def test_rectangle_vertices(spark):
    df = spark.createDataFrame([(1, "pad", 30.0, 20.0)], "id long, label string, W double, D double")
    got = geometry.rectangle_vertices(df).orderBy("id", "Order").collect()
    assert [(r.X, r.Y, r.Order) for r in got] == [(0, 0, 1), (0, 20, 2), (30, 20, 3), (30, 0, 4)]
    assert {r.label for r in got} == {"pad"}


def test_clean_news(spark):
    raw = "A{html}<b\r c>d</b> http://x.dk/1?å=2 12 Læs opOrdbogTekstAf Årup Jensen slut\nny"
    cleaned = one(spark, raw, X.clean_news)
    # One space each for tag, link and digits, plus the four spaces around them in the text.
    assert cleaned == "A  d" + " " * 7 + "slut ny"
    assert one(spark, None, X.clean_news) == ""


def test_clean_news_keeps_a_tag_that_spans_lines(spark):
    assert one(spark, "a <b\nc> d", X.clean_news) == "a <b c> d"


def test_clean_tech_whitelist(spark):
    # Of the digits only 0 and 9 survive the whitelist, and then count as a number.
    assert one(spark, "Café <b>1990–2</b>\u00a0a-b.\nhttp://x y\r", X.clean_tech) == "Caf b –b\u00a0ab   y "


def test_topic_words_are_glued_and_filtered(spark):
    text = "The quick<br>brown\nfoxes' jump4ing http://a/b overlazy dogs {html}ended"
    assert one(spark, text, X.topic_words) == ["quickbrownfoxes", "jumping", "overlazy", "dogs", "ended"]
    assert one(spark, None, X.topic_words) == []


def test_topic_tokens_stopwords_and_classes(spark):
    df = spark.createDataFrame([(1, "There really were great stories about robots making robots")], "id int, t string")
    dropped = words.ADJECTIVES + words.ADVERBS
    got = tokens.topic_tokens(df, "t", words.stopwords(), dropped)
    assert got.first().tokens == ["stories", "robots", "making", "robots"]  # "great" is a listed adjective
    kept = tokens.keep_word_classes(got, "id", words.class_table(spark, [("stories", "a"), ("making", "v")]))
    assert kept.first().tokens == ["robots", "making", "robots"]


def test_stopwords_are_a_union():
    assert words.stopwords(["a", "b"], ["b", "c"]) == ["a", "b", "c"]
    assert {"the", "said"} <= set(words.stopwords())


def test_split_spaces_and_count_terms(spark):
    assert one(spark, "", X.split_spaces) == [""]
    assert one(spark, "a  b", X.split_spaces) == ["a", "", "b"]
    assert one(spark, "Løkke,A b2 x_y É", X.count_terms) == ["løkke", "b2", "x_y"]


def test_squeeze(spark):
    assert one(spark, "a\n\nb  c --------- SPLIT ELEMENT --------- d", X.squeeze) == "a b c d"


def test_frequencies(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b", ""]), (2, ["a"]), (3, [])], "id int, tokens array<string>")
    assert {(r.term, r.df) for r in tokens.document_frequency(df).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in tokens.bag_of_words(df, "id").collect()} == {(1, "a", 2), (1, "b", 1), (2, "a", 1)}
    assert {r.term for r in tokens.pruned_vocabulary(df, "tokens", 1, 0.35).collect()} == {"b"}


def test_reports(spark):
    df = spark.createDataFrame([("a", "1.5"), ("a", "2.5"), ("b", None), (None, "9")], "k string, v string")
    df = df.withColumn("v", F.col("v").cast("decimal(12,6)"))
    means = {r.k: r.mean_v for r in reports.mean_by(df, ["k"], "v").collect()}
    assert means == {"a": 2.0, "b": None}
    assert [(r.k, r["count"]) for r in reports.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]
    assert {(r.column, r.dtype, r.non_null) for r in reports.null_profile(df).collect()} == {("k", "string", 3), ("v", "decimal(12,6)", 3)}


def test_markup_that_real_pages_have(spark):
    pages = [
        '<H1 CLASS=big>Caps &#x27;&Eacute;&trade;&#9999999;&#55296;&bogus; &amp;lt;</H1>', "<h1>plain</h1>",
        """<h1 title="a>b">kept</h1><a x='1' href='one'>1</a>""", "<h1>it's <a href=two>2</a></h1>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    rows = df.select("id", H.first_text(F.col("html"), "h1").alias("t"), H.attribute(F.col("html"), "a", "href").alias("a")).orderBy("id").collect()
    assert [r.t for r in rows] == ["Caps 'É™��&bogus; &lt;", "plain", "kept", "it's 2"]
    assert [r.a for r in rows] == [None, None, "one", "two"]
