"""The corpus pipeline against its operators and brute force, stage by stage."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_llm_operators import brute_base, brute_components, brute_targets

from newspulse.llm import mixing, quality_rules
from newspulse.session import stage

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = stage(spark.read.parquet(f"{SMALL}/documents.parquet"), "docs")
    names = [n for n, _ in corpus_pipeline.STAGES]
    steps = dict(corpus_pipeline.STAGES)

    good = stage(steps[names[0]](spark, docs, SMALL), "good")
    kept = quality_rules.judge(docs).where("kept").select("doc_id")
    assert good.columns == docs.columns
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in kept.collect())

    single = stage(steps[names[1]](spark, good, SMALL), "single")
    want = {root for _, root in brute_components([(r["doc_id"], r["text"]) for r in good.collect()]).values()}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == docs.columns

    clean = stage(steps[names[2]](spark, single, SMALL), "clean")
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not any(brute_base(r["text"]) for r in clean.collect())

    mixed = stage(steps[names[3]](spark, clean, SMALL), "mixed")
    assert mixed.columns == docs.columns
    sized = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    target, got, most = brute_targets(sized(clean)), sized(mixed), clean.agg(F.max(mixing.n_words(F.col("text")))).first()[0]
    assert all(abs(got.get(s, 0) - target[s]) <= most for s in target)

    packed = steps[names[4]](spark, mixed, SMALL)
    copies = mixed.groupBy("doc_id").count().collect()
    starts = {r["doc_id"]: r["count"] for r in packed.where("start = 0").groupBy("doc_id").count().collect()}
    assert starts == {r["doc_id"]: r["count"] for r in copies}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n <> end or n > 2048").isEmpty()


def test_run_gives_pieces(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100 and public_tokenizers.path("word_bpe_49k.json")
