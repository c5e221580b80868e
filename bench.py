"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the input folder, ``BENCH_CPUS`` the number of cores. After one warm-up run
of each query, the median of ``BENCH_RUNS`` runs counts. Results are written to the no-op sink,
so that every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from gridlens.catalog.queries import QUERIES

HEADLINE = [
    "parse_lines", "point_features", "threshold_alerts", "zscore_score", "ensemble_anomaly", "signal_stats", "peaks", "running_energy",
    "energy_report", "energy_audit", "session_summary", "every_nth", "latency_stats", "health_score", "insights_list", "recommendations",
    "feature_vector", "tumbling_features", "frame_sequences", "power_forecast", "stratified_split", "adc_to_rms", "ewma_snap",
    "merge_alerts_into_log",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf, "cores": cores}))


if __name__ == "__main__":
    main()
