"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query runs once to warm the JVM and
once timed; the timed run computes the whole result and discards it.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catchmark.catalog import all_queries

HEADLINE = (
    "pip_inner",
    "presence_counts",
    "region_share",
    "chi2_direct",
    "chi2_ref",
    "nearest_river_km",
    "nearest_water",
    "random_in_basins",
    "flow_stats",
    "basin_metrics",
    "exact_quantiles",
    "ecdf_rows",
    "tests_vs_random",
    "boot_with_repl",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, seconds = all_queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
