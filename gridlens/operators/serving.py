"""Latency and throughput of model calls, from the inference log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.config import KEYS
from gridlens.functions.numeric import half_up, micros, sdiv
from gridlens.operators.ordered import latest


def _uptime() -> Column:
    return (F.max(micros("ts")) - F.min(micros("ts"))) / F.lit(1e6)


def call_totals(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_inferences"),
        F.sum("latency_ms").alias("total_time_ms"),
        _uptime().alias("session_uptime_s"),
        F.sum("is_error").alias("error_count"),
    )


def latency_stats(log: DataFrame, history: int = 2000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals over all calls and the distribution of the newest ``history`` latencies."""
    x = F.col("latency_ms")
    ranks = F.percentile(x, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    spread = latest(log, history, keys).groupBy(*keys).agg(
        F.avg(x).alias("avg_latency_ms"),
        F.min(x).alias("min_latency_ms"),
        F.max(x).alias("max_latency_ms"),
        ranks.alias("_p"),
        F.stddev_pop(x).alias("std_latency_ms"),
    )
    rate = sdiv("total_inferences", "session_uptime_s").alias("throughput_ips")
    return call_totals(log, keys).join(spread, list(keys)).select(
        *keys,
        "total_inferences",
        "total_time_ms",
        "session_uptime_s",
        "error_count",
        "avg_latency_ms",
        "min_latency_ms",
        "max_latency_ms",
        *[F.col("_p")[n].alias(f"p{q}_latency_ms") for n, q in enumerate((50, 95, 99))],
        "std_latency_ms",
        rate,
    )


def latency_by_model(log: DataFrame, history: int = 500, load_times: DataFrame | None = None) -> DataFrame:
    """Mean and 95th percentile of each model's newest latencies; few calls have their maximum instead."""
    x = F.col("latency_ms")
    found = latest(log, history, ("model",)).groupBy("model").agg(
        F.avg(x).alias("avg_ms"), F.percentile(x, 0.95).alias("_p95"), F.max(x).alias("_max"), F.count(x).alias("count")
    )
    found = found.withColumn("p95_ms", F.when(F.col("count") >= 20, F.col("_p95")).otherwise(F.col("_max")))
    if load_times is None:
        found = found.withColumn("load_time_ms", F.lit(0.0))
    else:
        found = found.join(load_times, "model", "left").fillna(0.0, ["load_time_ms"])
    return found.select("model", "avg_ms", "p95_ms", "count", "load_time_ms")


def latency_stats_floor(log: DataFrame, history: int = 200, keys: Sequence[str] = KEYS) -> DataFrame:
    """The panel's figures: percentiles are the value at rank ``floor(n q)`` of the newest latencies."""
    x = F.col("latency_ms")
    spread = latest(log, history, keys).groupBy(*keys).agg(
        F.avg(x).alias("avg_ms"),
        F.min(x).alias("min_ms"),
        F.max(x).alias("max_ms"),
        F.stddev_pop(x).alias("std_ms"),
        F.sort_array(F.collect_list(x)).alias("_x"),
    )

    def at(q: float) -> Column:
        return F.element_at("_x", (F.floor(F.size("_x") * F.lit(q)) + 1).cast("int"))

    rate = F.col("total_inferences") / F.greatest(F.col("session_uptime_s"), F.lit(1.0))
    return call_totals(log, keys).join(spread, list(keys)).select(
        *keys,
        "total_inferences",
        rate.alias("throughput_ips"),
        "avg_ms",
        at(0.5).alias("p50_ms"),
        at(0.95).alias("p95_ms"),
        at(0.99).alias("p99_ms"),
        "min_ms",
        "max_ms",
        "std_ms",
    )


def perf_snapshot(stats: DataFrame, at: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rounded figures of ``latency_stats`` with the time of the newest call in ``at``."""
    newest = at.groupBy(*keys).agg(F.max("ts").alias("timestamp"))
    return stats.join(newest, list(keys)).select(
        *keys,
        "timestamp",
        "total_inferences",
        half_up("avg_latency_ms", 3).alias("avg_latency_ms"),
        half_up("p95_latency_ms", 3).alias("p95_latency_ms"),
        half_up("throughput_ips", 2).alias("throughput_ips"),
        "error_count",
    )


def recent_latencies(log: DataFrame, n: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest latencies in order, also scaled between their lowest and highest."""
    rows = latest(log, n, keys)
    device = Window.partitionBy(*keys)
    low, high = F.min("latency_ms").over(device), F.max("latency_ms").over(device)
    return rows.withColumns(
        {
            "x": F.count(F.lit(1)).over(device) - F.col("age"),
            "scaled": (F.col("latency_ms") - low) / F.greatest(high - low, F.lit(0.001)),
        }
    ).drop("age")
