"""Tables stored by key, and streams that remember their keys in a state store."""

import re

import pytest

from newspulse.operators import dedup
from newspulse.sources import stored
from newspulse.streaming import state

KIND = "link string, row long, text string"


def batches(spark):
    first = [(f"l{i % 40}", i, f"a{i}") for i in range(120)] + [(None, 500 + i, "n") for i in range(60)]
    second = [(f"l{i}", 1000 + i, f"b{i}") for i in range(20, 70)] + [(None, 2000, "m"), ("l69", 3000, "late")]
    return [spark.createDataFrame(rows, KIND) for rows in (first, second)]


@pytest.fixture()
def store(spark, tmp_path):
    name = "store_" + re.sub(r"\W", "_", tmp_path.name)
    stored.create_store(spark, name, spark.createDataFrame([], KIND).schema, "link", str(tmp_path / "s"), 8, 4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def rows_of(df):
    return sorted((r["link"] or "", r["row"], r["text"]) for r in df.collect())


def test_appends_equal_the_full_merge_and_a_replay_adds_nothing(spark, store):
    both = batches(spark)
    want = rows_of(dedup.first_per_key(both[0].union(both[1]), ["link"], ["row"]))
    for batch in (*both, both[1], both[0], spark.createDataFrame([], KIND)):
        stored.append_unseen(batch, store, ["row"])
    assert rows_of(spark.table(store).drop(stored.SLICE)) == want and len(want) == 71


def test_a_later_session_finds_the_files(spark, store, tmp_path):
    both = batches(spark)
    stored.append_unseen(both[0], store, ["row"])
    again = store + "_again"  # a catalog that does not know the table yet
    stored.create_store(spark, again, both[0].schema, "link", str(tmp_path / "s"), 8, 4)
    stored.append_unseen(both[1], again, ["row"])
    assert rows_of(spark.table(again).drop(stored.SLICE)) == rows_of(
        dedup.first_per_key(both[0].union(both[1]), ["link"], ["row"]))
    spark.sql(f"DROP TABLE {again}")


def test_only_files_of_the_batch_are_read_and_the_stored_side_is_not_shuffled(spark, store, tmp_path):
    stored.append_unseen(batches(spark)[0], store, ["row"])
    few = spark.createDataFrame([("l3", 1, "x"), ("new", 2, "y")], KIND)
    seen = stored.seen_keys(spark, store, few)
    assert [r[0] for r in seen.collect()] == ["l3"]
    scan = spark.table(store).where(f"{stored.SLICE} in ({', '.join(str(r[0]) for r in few.select(stored.key_slice('link', 8)).collect())})")
    assert 0 < len(scan.inputFiles()) < len(spark.table(store).inputFiles())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a batch too large to broadcast
    try:
        plan = stored.seen_keys(spark, store, few)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "PartitionFilters: [" in plan and f"{stored.SLICE}#" in plan
    stored_side = plan[plan.index("SortMergeJoin"):]
    branch = stored_side[:stored_side.index("FileScan")]
    assert "Exchange" not in branch and "Bucketed: true" in plan


def stream_of(spark, folder):
    return spark.readStream.schema(KIND).json(str(folder))


def test_repeats_are_dropped_across_restarts(spark, tmp_path):
    both, folder = batches(spark), tmp_path / "in"
    for batch in both:
        batch.coalesce(1).write.mode("append").json(str(folder))
        state.run_available(stream_of(spark, folder), str(tmp_path / "out"), str(tmp_path / "mark"), "link", ("row",)).awaitTermination()
    got = spark.read.schema(KIND).parquet(str(tmp_path / "out"))
    assert rows_of(got) == rows_of(dedup.first_per_key(both[0].union(both[1]), ["link"], ["row"]))
    assert all(spark.conf.get(name, None) != value for name, value in state.SETTINGS.items())  # the session is as before


def test_a_key_returns_after_its_time_to_live(spark, tmp_path):
    folder = tmp_path / "in"

    def run(i):
        spark.createDataFrame([("a", i, "x")], KIND).coalesce(1).write.mode("append").json(str(folder))
        state.run_available(
            stream_of(spark, folder), str(tmp_path / "out"), str(tmp_path / "mark"), "link", ("row",), ttl_ms=1).awaitTermination()

    run(1)
    run(2)
    assert [r["row"] for r in spark.read.schema(KIND).parquet(str(tmp_path / "out")).orderBy("row").collect()] == [1, 2]
