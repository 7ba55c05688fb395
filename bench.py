"""Headline queries over whole tables; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every query
is planned, run and fully materialised (the ``noop`` sink takes all rows). The
given tables are files of one row group, which one task would read; they are
dealt over as many files as there are cores first, outside the clock.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "raw_snapshot",
    "compact_snapshot",
    "snapshot_report",
    "llm_input",
    "discover",
    "exclude_gitignore",
    "outline_lines",
    "file_symbols",
    "class_methods",
    "names_by_kind",
    "summary_parse",
    "binary_detect",
    "size_info",
    "lang_distribution",
    "repo_profile",
    "resolve_best",
    "resolve",
    "extract_blocks",
    "extract_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # one machine: intermediate tables go to a folder of this run
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sylvan-bench-"))
        # no call-site capture for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    dealt = tempfile.mkdtemp(prefix="sylvan-bench-data-")
    for name in ("documents", "pages"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(int(cpus))
        table.write.parquet(f"{dealt}/{name}.parquet")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, dealt).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
