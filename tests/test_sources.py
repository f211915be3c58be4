"""Sources and sinks (S1-S15), unions of files (U1), streaming append (R1)."""

import json
from datetime import date, datetime

import pytest
from pyspark.ml.clustering import LDAModel
from pyspark.sql import functions as F

from newspulse import schemas as S
from newspulse.operators import dedup, filters
from newspulse.sources import readers, writers
from newspulse.streaming import daily

ARTICLES = {
    "articles_2022-08-01.csv": (
        'link,title,content,medie\n'
        'http://a.dk/nyheder/x/1,En,"Linje et\nlinje ""to""",TV2\n'
        'http://a.dk/2,To,Tekst to,BT\n'
        ',Uden link,Tekst,DR\n'
    ),
    "articles_2022-08-02.csv": (
        'link,title,content,medie\n'
        'http://a.dk/2,To igen,Tekst to senere,BT\n'
        ',Uden link igen,Tekst,DR\n'
        'http://a.dk/3,Tre,x,EB\n'
    ),
}


def write_days(folder, names=None):
    folder.mkdir(exist_ok=True)
    for name, text in ARTICLES.items():
        if names is None or name in names:
            (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_scan_daily_csv(spark, tmp_path):
    rows = readers.daily_articles(spark, write_days(tmp_path / "days")).collect()
    assert len(rows) == 6
    assert {r.Filename for r in rows} == set(ARTICLES)
    first = next(r for r in rows if r.title == "En")
    assert first.content == 'Linje et\nlinje "to"'
    ordered = sorted((r for r in rows if r.Filename.endswith("01.csv")), key=lambda r: r.row_id)
    assert [r.title for r in ordered] == ["En", "To", "Uden link"]


def test_first_article_per_link_and_null_links_collapse(spark, tmp_path):
    days = readers.daily_articles(spark, write_days(tmp_path / "days"))
    kept = dedup.first_per_key(days, ["link"], ["Filename", "row_id"]).collect()
    assert sorted(r.title for r in kept) == ["En", "To", "Tre", "Uden link"]


def test_csv_table_reads_declared_schema(spark, tmp_path):
    (tmp_path / "news.csv").write_text('source_id,source_name,author,title\nwired,Wired,,"A, b"\n')
    schema = S.T.StructType(S.NEWS_TABLE.fields[:4])
    row = readers.csv_table(spark, str(tmp_path / "news.csv"), schema).first()
    assert (row.source_id, row.author, row.title) == ("wired", None, "A, b")


def article(source, title, **more):
    return {"source": {"id": source, "name": source.title()}, "title": title, "url": f"http://{source}/{title}", **more}


def test_json_articles_flatten(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"status": "ok", "articles": [article("wired", "A"), article("verge", "B")]}, indent=1))
    (tmp_path / "p2.json").write_text(json.dumps({"status": "ok", "articles": [article("wired", "C", extra=1)]}))
    table = readers.json_articles(spark, str(tmp_path))
    assert table.columns == S.NEWS_TABLE.fieldNames()
    assert sorted((r.source_id, r.source_name, r.title) for r in table.collect()) == [
        ("verge", "Verge", "B"), ("wired", "Wired", "A"), ("wired", "Wired", "C"),
    ]


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"id": "wired", "category": "technology", "language": "en", "country": "us"}]}))
    table = readers.json_sources(spark, str(tmp_path))
    row = table.first()
    assert (row.id, row.category, row.name) == ("wired", "technology", None)
    assert [r.source_id for r in readers.choose_sources(table).collect()] == ["wired"]
    assert readers.choose_sources(table, category="general").count() == 0
    assert readers.choose_sources(table, None, None, None).count() == 1


def test_json_feed_with_and_without_list(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"feed": [{"title": "T", "summary": "S", "time_published": "20240102T030405"}]}))
    (tmp_path / "limit.json").write_text(json.dumps({"Information": "rate limit"}))
    items, status = readers.json_feed(spark, str(tmp_path))
    assert [r.title for r in items.collect()] == ["T"]
    assert {r.file_name: (r.has_feed, r.message) for r in status.collect()} == {
        "ok.json": (True, None), "limit.json": (False, "rate limit"),
    }


def test_html_and_text_files_are_whole_rows(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html>\n<h1>x</h1></html>")
    assert readers.html_pages(spark, str(tmp_path)).first().html == "<html>\n<h1>x</h1></html>"
    assert readers.text_documents(spark, str(tmp_path)).first().file_name == "a.html"


def test_snapshot_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "snap")
    one = spark.createDataFrame([(1,), (2,)], "x int")
    assert not writers.snapshot(one, path, date(2024, 1, 1), enabled=False)
    assert writers.snapshot(one, path, date(2024, 1, 1))
    assert writers.snapshot(one, path, date(2024, 1, 2))
    assert writers.snapshot(one.limit(1), path, date(2024, 1, 2))
    counts = {r.run_date: r["count"] for r in spark.read.parquet(path).groupBy("run_date").count().collect()}
    assert counts == {date(2024, 1, 1): 2, date(2024, 1, 2): 1}


def test_csv_export_round_trip(spark, tmp_path):
    text = 'a "quoted"\nline, with comma'
    df = spark.createDataFrame([("l", "t", text, "TV2")], S.DAILY_ARTICLES)
    writers.csv_export(df, str(tmp_path / "out"))
    assert readers.csv_table(spark, str(tmp_path / "out"), S.DAILY_ARTICLES).first().content == text


def test_replace_table_by_a_query_on_itself(spark):
    writers.replace_table(spark.createDataFrame([("a",), ("[Removed]",), (None,)], "title string"), "news_s4")
    new = spark.createDataFrame([("a",), ("b",)], "title string")
    merged = dedup.merge_distinct(readers.sql_table(spark, "news_s4"), new)
    writers.replace_table(merged, "news_s4")
    titles = [r.title for r in spark.table("news_s4").collect()]
    assert len(titles) == 3 and set(titles) == {None, "a", "b"}
    assert not spark.catalog.tableExists("news_s4__staging") and not spark.catalog.tableExists("news_s4__old")


def test_unseen_rows_equal_the_full_merge(spark):
    existing = spark.createDataFrame([("a", 1), (None, 2)], "title string, n int")
    new = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("b", 3), ("[Removed]", 4), (None, 5)], "title string, n int")
    full = {tuple(r) for r in dedup.merge_distinct(existing, new).collect()}
    added = [tuple(r) for r in dedup.unseen_rows(existing, new).collect()]
    assert full == {("a", 1), (None, 2)} | set(added) and len(added) == 2


def test_landed_articles_first_pages_of_each_source(spark):
    rows = [(f"u{i}", "s1" if i % 2 else "s2", float(i % 7), datetime(2024, 1, 1 + i % 6, 12)) for i in range(60)]
    df = spark.createDataFrame(rows + [("x", "s3", 99.0, datetime(2024, 1, 3))], "url string, source_id string, popularity double, published timestamp")
    sources = spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    got = readers.landed_articles(df, sources, date(2024, 1, 2), date(2024, 1, 4), pages=2, page_size=3)
    want = {}
    for url, s, pop, ts in rows:
        if date(2024, 1, 2) <= ts.date() <= date(2024, 1, 4):
            want.setdefault(s, []).append((-pop, url))
    expected = {(u, i // 3 + 1) for s in want for i, (_, u) in enumerate(sorted(want[s])[:6])}
    assert {(r.url, r.page) for r in got.collect()} == expected


def test_large_page_ranges_use_the_sliced_cut_with_the_same_result(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id"), (F.col("id") % 97).alias("v"))
    got = dedup.top_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 1500)
    expected = sorted(((-(i % 97), i) for i in range(5000)))[:1500]
    assert sorted(r.id for r in got.collect()) == sorted(i for _, i in expected)


def test_latest_days_window(spark):
    lo, hi = readers.latest_days(F.lit(date(2024, 3, 10)))
    assert tuple(spark.range(1).select(lo, hi).first()) == (date(2024, 3, 5), date(2024, 3, 9))
    days = spark.createDataFrame([(d, datetime(2024, 3, d, 23, 59)) for d in range(3, 12)], "d int, ts timestamp")
    assert sorted(r.d for r in filters.in_window(days, "ts", lo, hi).collect()) == [5, 6, 7, 8, 9]


def test_latest_feed(spark):
    rows = [(i, datetime(2022 + i % 3, 1, 1)) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    got = readers.latest_feed(df, "ts", "id", date(2024, 6, 1), limit=4).collect()
    assert [r.id for r in got] == [2, 5, 8, 1]


def test_stream_dedup(spark, tmp_path):
    folder, table, mark = tmp_path / "days", str(tmp_path / "table"), str(tmp_path / "mark")
    write_days(folder, ["articles_2022-08-01.csv"])
    daily.run_available(daily.article_stream(spark, str(folder)), table, mark).awaitTermination()
    assert spark.read.parquet(table).count() == 3
    write_days(folder)
    daily.run_available(daily.article_stream(spark, str(folder)), table, mark).awaitTermination()
    stored = spark.read.parquet(table).collect()
    batch = dedup.first_per_key(readers.daily_articles(spark, str(folder)), ["link"], ["Filename", "row_id"]).collect()
    assert sorted((r.link or "", r.title) for r in stored) == sorted((r.link or "", r.title) for r in batch)


def test_replayed_batch_adds_nothing(spark, tmp_path):
    days = readers.daily_articles(spark, write_days(tmp_path / "days"))
    table = str(tmp_path / "t")
    daily.append_new(days, table)
    before = spark.read.parquet(table).count()
    daily.append_new(days, table)
    assert spark.read.parquet(table).count() == before == 4


def test_dedup_within_watermark(spark, tmp_path):
    folder = write_days(tmp_path / "days")
    stream = daily.dedup_within(daily.article_stream(spark, folder))
    query = (
        stream.writeStream.format("memory").queryName("within").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.link or "" for r in spark.table("within").collect()) == ["", "http://a.dk/2", "http://a.dk/3", "http://a.dk/nyheder/x/1"]


def test_save_and_load_model(spark, tmp_path):
    from newspulse.operators import topics
    docs = spark.createDataFrame([(i, ["alpha", "beta"] if i % 2 else ["gamma", "delta"]) for i in range(30)], "id int, tokens array<string>")
    corpus = topics.build_corpus(docs, "id", no_below=1, no_above=1.0)
    model = topics.train(corpus, 2, passes=3, share=1.0, seed=1)
    assert writers.save_model(str(tmp_path), "r0", model, corpus.counter, enabled=False) is None
    folder = writers.save_model(str(tmp_path), "r1", model, corpus.counter, news=docs)
    loaded, counter = writers.load_model(spark, folder)
    assert isinstance(loaded, LDAModel) and loaded.vocabSize() == 4
    assert sorted(counter.vocabulary) == ["alpha", "beta", "delta", "gamma"]
    assert spark.read.parquet(f"{folder}/news").count() == 30


def test_csv_with_another_column_order_is_an_error(spark, tmp_path):
    (tmp_path / "articles_2022-08-02.csv").write_text("title,content,link,medie\nT,C,L,EB\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.daily_articles(spark, str(tmp_path)).collect()
