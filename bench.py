"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default sf0.1) with
``local[$BENCH_CPUS]``, fully materialised through the ``noop`` sink: one
warm-up, then the median of ``$BENCH_RUNS`` timed runs.  Prints one JSON line.

The driver's tables are files of one row group, which no engine can split.
They are landed once, untimed, as ``$BENCH_FILES`` files each (default 16; 0
reads them as they are), as a table of any size would be.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["department_pay", "dept_seniority_matrix", "skill_counts", "dept_skill_matrix", "box_stats",
            "weekly_open_roles", "recurring_titles", "fold_snapshots", "comparables_all", "word_freq",
            "tfidf_matrix", "kmeans_8", "salary_block", "html_to_markdown", "skill_phrases", "backfill_description"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from pyspark.sql import SparkSession
    from paygrid.session import ensure_checkpoint_dir
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("paygrid-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("PAYGRID_DRIVER_MEMORY", "16g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)

    from paygrid.plans import load_all
    from paygrid.sources.fixture import TABLES
    queries, _ = load_all()
    files, source = int(os.environ.get("BENCH_FILES", "16")), sf_dir
    if files:
        sf_dir = f"{ensure_checkpoint_dir(spark)}/landed-{files}"
        for t in TABLES:
            spark.read.parquet(f"{source}/{t}.parquet").repartition(files).write.mode("overwrite").parquet(f"{sf_dir}/{t}.parquet")

    def once(name: str) -> float:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    results = {}
    for name in only:
        once(name)                                   # warm-up
        results[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"# {name}: {results[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)$", source)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": float(m.group(1)) if m else source,
                      "runs": runs, "cpus": int(cpus), "files": files}))


if __name__ == "__main__":
    main()
