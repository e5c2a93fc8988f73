"""Time the headline queries; prints one JSON line.

Input folder ``$BENCH_SF_DIR``, cores ``$BENCH_CPUS``, timed runs per query
``$BENCH_RUNS``.  Each query is built and run to a sink that discards rows,
once to warm up and then as timed runs; the median counts.  ``$BENCH_DETAIL=1``
shows progress on stderr.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from broadsheet.session import build_session  # noqa: E402
from checks.spark_queries import QUERIES  # noqa: E402

HEADLINE = [
    "clean_text",
    "word_count",
    "phrase_count",
    "top_keywords",
    "vocabulary_keywords",
    "classify_articles",
    "vocabulary_labels",
    "top_categories",
    "categories_by_date",
    "categories_by_domain",
    "keyword_by_date",
    "keyword_pair_by_date",
    "country_mentions",
    "corpus_stats",
    "articles_per_host",
    "category_keywords",
    "extract_links",
    "new_links",
    "frontier_round_robin",
    "extract_articles",
    "stored_articles",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        if os.environ.get("BENCH_DETAIL"):
            print(f"{name:28s} {seconds[name]:.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
