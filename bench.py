"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from newspulse.catalog import QUERIES  # noqa: E402
from newspulse.session import build_session  # noqa: E402

HEADLINE = [
    "html_article", "html_links", "clean_news", "clean_tech", "topic_filter", "currency_class", "topic_tokens",
    "bag_of_words", "vocab_pruned", "sentiment_mean", "sentiment_polarity", "sentiment_compound",
    "multi_column_sentiment", "sentiment_by_category", "entity_mentions", "entity_totals",
    "entity_media_sentiment", "entity_polarity_cross", "find_top", "dedup_link", "append_distinct",
    "paged_window", "top1_per_group", "join_sorted", "rect_polygon", "coherence_cv", "dominant_topic",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed scan: session start and class loading are not what is measured.
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
