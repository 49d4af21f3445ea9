"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and the cores; BENCH_RUNS the number
of timed runs after one warm-up, of which the median counts; BENCH_QUERIES a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from threadloom.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "read_pages",
    "select_nodes",
    "page_title",
    "html_to_markdown_pages",
    "extract_posts",
    "classify_page",
    "page_completeness_strict",
    "assemble_threads",
    "assemble_posts_continuous",
    "render_threads",
    "render_forum_threads",
    "escape_markdown",
    "extract_image_links",
    "resolve_assets",
    "rewrite_image_links",
    "annotate_share_links",
    "content_address",
    "share_file_lists",
    "parse_scope_rules",
    "match_rules",
    "verify_manifest",
    "sync_plan",
    "decode_payloads",
    "audit_transfers",
    "resolve_attempts",
    "dedupe_names",
    "flatten_tree",
    "upsert_threads",
    "ingest_pages_stream",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = session(cpus)
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
