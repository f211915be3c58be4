"""Topic models (M1-M14), coherence against brute force, synthetic customers (G1-G6)."""

import math
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from newspulse.catalog import QUERIES
from newspulse.functions.rows import small_table
from newspulse.operators import coherence, generate, topics
from newspulse.plans import topics as flow
from newspulse.session import stage_dir

SPORT = "football match goal league player coach".split()
MONEY = "market bank shares rates profit trade".split()


RIVALS = ["North", "South", "East"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [str(w) for w in rng.choice(SPORT if i % 2 else MONEY, 12)]) for i in range(60)] + [(60, [""]), (61, [])]
    return spark.createDataFrame(rows, "id int, tokens array<string>").cache()


@pytest.fixture(scope="module")
def fitted(spark, docs):
    corpus = topics.build_corpus(docs, "id", no_below=2, no_above=0.6)
    return corpus, topics.train(corpus, 2, passes=20, share=1.0, seed=5)


def test_vocabulary_bounds(spark, docs):
    full = topics.build_corpus(docs, "id", prune=False)
    assert {r.term for r in full.vocabulary.collect()} == set(SPORT + MONEY)
    none = topics.build_corpus(docs, "id", no_below=2, no_above=0.6)
    assert none.size == 62


def test_shares_sum_to_one_and_empty_documents_have_no_topic(fitted):
    corpus, model = fitted
    rows = {r.id: r.topic_share for r in topics.document_topics(model, corpus).collect()}
    assert rows[60] is None and rows[61] is None
    assert all(abs(sum(v) - 1) < 1e-6 for v in rows.values() if v)


def test_same_seed_same_model(fitted):
    corpus, model = fitted
    again = topics.train(corpus, 2, passes=20, share=1.0, seed=5)
    assert np.allclose(model.topicsMatrix().toArray(), again.topicsMatrix().toArray())


def test_dominant_topic_separates_the_two_subjects(spark, fitted, docs):
    corpus, model = fitted
    words = topics.topic_words(model, corpus.vocabulary, 6)
    by_topic = {t: {r.term for r in words.collect() if r.topic == t} for t in (0, 1)}
    assert set(map(frozenset, by_topic.values())) == {frozenset(SPORT), frozenset(MONEY)}
    names = topics.keywords(topics.topic_words(model, corpus.vocabulary))
    dominant = topics.dominant_topic(topics.document_topics(model, corpus), "id", names)
    rows = {r.id: r for r in dominant.collect()}
    assert rows[60].Dominant_Topic is None
    assert len({rows[i].Dominant_Topic for i in range(0, 60, 2)}) == 1
    assert rows[0].Topic_Keywords.split(", ")[0] in MONEY
    news = docs.select("id", F.concat(F.lit("title "), "id").alias("title"))
    representatives = topics.representative_documents(dominant, news, "id")
    best = {r.Repr_Dominant_Topic: r for r in representatives.collect()}
    for t, row in best.items():
        shares = [(-r.Perc_Contribution, r.id) for r in rows.values() if r.Dominant_Topic == t]
        assert row.Representative_Text == f"title {min(shares)[1]}"
    joined = topics.topic_articles(news, dominant, representatives, "id").collect()
    assert [r.id for r in joined] == [i for _, i in sorted((r.Dominant_Topic, r.id) for r in rows.values() if r.Dominant_Topic is not None)]


def test_prevalence_and_relevance(fitted):
    corpus, model = fitted
    shares = topics.document_topics(model, corpus)
    assert sum(r.share for r in topics.prevalence(shares).collect()) == pytest.approx(1.0)
    table = topics.relevance(topics.topic_words(model, corpus.vocabulary, model.vocabSize()), shares, n=3).collect()
    assert Counter(r.topic for r in table) == {0: 3, 1: 3}
    for t in (0, 1):
        ranked = sorted((r for r in table if r.topic == t), key=lambda r: r.rank)
        assert [r.relevance for r in ranked] == sorted((r.relevance for r in ranked), reverse=True)


def test_model_pick(spark):
    scores = spark.createDataFrame([(15, 0.4), (17, 0.6), (16, 0.6)], "k int, score double")
    assert tuple(topics.pick_model(scores).first()) == (16, 0.6, 3)


def brute_coherence(texts, lists, window):
    windows = []
    for t in texts:
        windows += [set(t[i:i + window]) for i in range(max(1, len(t) - window + 1))]
    n = len(windows)
    p = lambda *ws: sum(all(w in s for w in ws) for s in windows) / n
    out = {}
    for topic, ws in lists.items():
        def npmi(a, b):
            if p(a) * p(b) == 0:
                return 0.0
            joint = p(a, b) + 1e-12
            return math.log(joint / (p(a) * p(b))) / -math.log(joint)
        vectors = {a: np.array([npmi(a, b) for b in ws]) for a in ws}
        total = sum(vectors.values())
        cos = [v @ total / (np.linalg.norm(v) * np.linalg.norm(total)) if v.any() else 0.0 for v in vectors.values()]
        out[topic] = float(np.mean(cos))
    return out


@pytest.mark.parametrize("window", [3, 5, 110])
def test_coherence_against_brute_force(spark, window):
    rng = np.random.default_rng(1)
    texts = [[str(w) for w in rng.choice(list("abcdefgh"), n)] for n in (0, 1, 3, 7, 20, 60, 150, 300)]
    lists = {0: ["a", "b", "c"], 1: ["a", "d", "zz"], 2: ["e", "f", "g", "h"]}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>")
    words = small_table(spark, [(t, w) for t, ws in lists.items() for w in ws], "topic int, term string")
    got = {r.topic: r.coherence for r in coherence.topic_coherence(df, "id", "tokens", words, window).collect()}
    want = brute_coherence(texts, lists, window)
    assert set(got) == set(want)
    for t in want:
        assert got[t] == pytest.approx(want[t], abs=1e-9)


def test_topic_flow_picks_the_best_model(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        ws = [str(w) for w in rng.choice(SPORT if i % 2 else MONEY, 8)]
        rows.append((i, " ".join(ws[:4]), " ".join(ws[4:]) if i else None, f"2022-02-{1 + i % 28:02d}T10:00:00Z"))
    news = spark.createDataFrame(rows, "id int, title string, description string, publishedAt string")
    prepared = flow.prepare(news, ["with"])
    assert prepared.where("id = 0").first().tokens == []  # no description: no analysis text
    done = flow.analyse(prepared, "id", ks=[2, 3], passes=10, share=1.0, seed=2, no_below=1, no_above=1.0)
    scores = {r.k: r.score for r in done.scores.collect()}
    assert set(scores) == {2, 3} and done.model.getK() == max(scores, key=lambda k: (scores[k], -k))
    assert done.articles.count() == 39 and sum(r["count"] for r in done.counts.dropna().collect()) == 39


class _Session:
    """Just enough of a session to ask for its stage folder."""

    def __init__(self, **settings):
        self.conf = type("F", (), {"get": staticmethod(lambda key, default=None: settings.get(key, default))})()


def test_stage_folder_is_the_setting_or_lies_below_the_warehouse():
    both = {"spark.checkpoint.dir": "hdfs://x/stage", "spark.sql.warehouse.dir": "hdfs://x/warehouse/"}
    assert stage_dir(_Session(**both)) == "hdfs://x/stage"
    del both["spark.checkpoint.dir"]
    assert stage_dir(_Session(**both)) == "hdfs://x/warehouse/_staged"


TODAY = date(2024, 5, 1)


@pytest.fixture(scope="module")
def people(spark):
    return generate.customers(spark, RIVALS, 5000, TODAY, seed=9).cache()


def test_churn_gen(spark, people):
    r = people.agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.countDistinct("id").alias("ids"),
        F.avg(F.col("churn").cast("int")).alias("rate"), F.avg("churn_probability").alias("p"),
        F.avg("customer_value").alias("mean"), F.stddev("customer_value").alias("sd"),
        F.countDistinct("competitor").alias("labels"), F.max("birth_date").alias("young"),
        F.min("start_date").alias("s0"), F.max("start_date").alias("s1"), F.corr(F.col("churn").cast("int"), "churn_probability").alias("c"),
        F.count_if(F.col("churn_date") < F.col("start_date")).alias("early"), F.count("churn_date").alias("dates"),
    ).first()
    assert (r.n, r.labels, r.dates) == (5000, len(RIVALS), 5000) and 0 <= r.lo and r.hi < 100_000 and r.ids < 5000
    assert abs(r.rate - 0.25) < 0.03 and abs(r.p - 0.5) < 0.02 and abs(r.c) < 0.05
    assert abs(r["mean"] - 25_000) < 600 and abs(r.sd - 10_000) < 500
    assert r.young <= date(2006, 5, 1) and r.s0 >= date(2010, 1, 1) and r.s1 <= TODAY and r.early > 0


def test_churn_gen_does_not_depend_on_partitioning(spark, people):
    one = generate.customers(spark, RIVALS, 5000, TODAY, seed=9).coalesce(1)
    assert one.exceptAll(people).count() == 0
    assert generate.customers(spark, RIVALS, 5000, TODAY, seed=10).exceptAll(people).count() > 4000


def test_clean_up(people):
    cleaned = generate.clean_up(people, F.lit(TODAY))
    r = cleaned.agg(
        F.count_if(F.col("churn") != F.col("churn_date").isNotNull()).alias("bad"), F.min("age").alias("age")
    ).first()
    assert r.bad == 0 and r.age >= 18


def test_shares_are_read_back_and_not_made_anew_for_every_mention(spark, tmp_path):
    rows = [(i, t, "en", "web", 1) for i, t in enumerate(["thon ther queque", "einheit geheit einheit", "queque", "no word of a list", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    counts, joined = (QUERIES[name](spark, str(tmp_path)) for name in ("topic_counts", "topic_articles"))
    assert [r["count"] for r in counts.collect()] == [1, 1, 1]
    assert {r.doc_id: r.Dominant_Topic for r in joined.collect()} == {0: 0, 1: 2, 2: 1}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2  # for the weights of the lists only; 21 when shares were made anew
