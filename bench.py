"""Time the headline queries; prints one JSON line.

Each query runs over its whole tables into a no-op sink. The first run warms up code generation and the
Python workers; the reported time is the median of the following runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from registry import catalog  # noqa: E402

HEADLINE = [
    "canonicalize_url",
    "resolve_url",
    "skip_reason",
    "extract_links",
    "html_tokens",
    "html_to_text",
    "strategy_texts",
    "build_page_doc",
    "api_fallback",
    "render_page_json",
    "normalize_text",
    "repetition_penalty",
    "robots_filter",
    "page_budget",
    "read_sitemap_xml",
    "expand_sitemap_index",
    "bfs_discover",
    "render_site_md",
    "render_site_json",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagewright-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagewright-bench-", dir="/tmp"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):
            begun = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: first {times[0]:.2f}, then {seconds[name]:.2f}", file=sys.stderr, flush=True)
    spark.stop()
    report = {
        "metric": "total of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
