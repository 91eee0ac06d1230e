"""Time the headline queries and print one JSON line: the median of three runs each.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the number of local cores. The store is
loaded once and timed; the flat files that some queries scan are written before, untimed.
"""

from __future__ import annotations

import json
import os
import statistics as statistics_of
import sys
import time

from pyspark.sql import SparkSession

from priceshape.scratch import scratch_path
from verification import fields, jobs, scans, statistics  # noqa: F401
from verification.base import QUERIES, store

HEADLINE = [
    "g1_growth_components",
    "g2_group_summary",
    "g3_compute_groups",
    "g4_right_tail",
    "g5_panel",
    "g6_metrics_timeseries",
    "g7_analyze_curves",
    "g7_analyze_histograms",
    "g8_series_view",
    "g14_metric_frame",
    "a7_weighted_quantile",
    "a7_split_cells",
    "a9_weighted_trimmed_mean",
    "a12_kde_mode",
    "a13_kde_curve",
    "a14_summary_weighted",
    "a14_summary_unit_weights",
    "a14_summary_ties",
    "a14_summary_ungrouped",
    "a15_histogram",
    "a16_axis_limits_ungrouped",
    "d2_upsert_union",
    "d4_first_wins_rows",
    "f15_growth_ratio",
    "w3_keep_one_per_key",
    "r8_multi_file_scan",
    "k6_upsert_observations",
    "k8_landing_refresh",
]

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    start = time.perf_counter()
    store(spark, sf_dir)
    seconds["load_store"] = round(time.perf_counter() - start, 3)
    scans.flat_folder(spark, sf_dir)
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.mode("append").parquet(scratch_path(spark, "bench"))
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics_of.median(runs), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
