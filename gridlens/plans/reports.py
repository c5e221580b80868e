"""Daily, monthly and full reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, Settings
from gridlens.functions.numeric import half_up
from gridlens.functions.scalar import load_status3
from gridlens.operators.energy import energy_steps, energy_totals, first_peak, peaks, power_columns, running_energy
from gridlens.operators.insights import efficiency_with_advice
from gridlens.operators.settings import resolved

KINDS = ("daily", "monthly", "full")


def daily_report(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Readings of each device's newest day with the meter level and status."""
    newest = df.groupBy(*keys).agg(F.to_date(F.max("ts")).alias("_day"))
    today = running_energy(df, keys, **split).join(newest, list(keys)).filter(F.to_date("ts") == F.col("_day"))
    today, s = resolved(today, settings, keys)
    return today.select(
        *keys,
        "seq",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("voltage").alias("voltage_v"),
        F.col("current").alias("current_a"),
        F.col("power").alias("power_w"),
        half_up("energy_kwh", 4).alias("energy_kwh"),
        load_status3(s=s).alias("status"),
    )


def monthly_report(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Energy, cost and power peak per day of each device's newest month."""
    peak, at = first_peak("power")
    day = F.to_date("ts").alias("day")
    steps, s = resolved(energy_steps(power_columns(df, keys), keys, **split), settings, keys)
    daily = steps.groupBy(*keys, day).agg(
        F.sum("kwh").alias("_kwh"), F.sum(F.col("kwh") * s.cost_per_kwh).alias("_spent"), peak.alias("peak_power_w"), at.alias("_at")
    )
    last = F.max("day").over(Window.partitionBy(*keys))
    current = daily.withColumn("_last", last).filter(F.date_trunc("month", "day") == F.date_trunc("month", "_last"))
    return current.select(
        *keys,
        F.col("day").cast("string").alias("day"),
        half_up("_kwh", 4).alias("energy_kwh"),
        half_up("_spent", 2).alias("cost"),
        "peak_power_w",
        F.date_format("_at", "yyyy-MM-dd HH:mm:ss").alias("peak_power_time"),
    )


def full_report(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Efficiency figures with the titles of the recommendations."""
    return efficiency_with_advice(df, settings, keys, **split)


def report_summary(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Lines under each report: peaks, energy and cost."""
    totals = energy_totals(df, settings, keys, **split).select(
        *keys, half_up("energy_kwh", 4).alias("energy_kwh"), half_up("spent", 2).alias("cost")
    )
    return peaks(df, keys).join(totals, list(keys))


def report(df: DataFrame, kind: str, settings: Settings | DataFrame = DEFAULTS, **split) -> DataFrame:
    """The report of a kind in ``KINDS``."""
    if kind not in KINDS:
        raise ValueError(f"unknown report {kind!r}")
    build = {"daily": daily_report, "monthly": monthly_report, "full": full_report}[kind]
    return build(df, settings, **split)


def write_report(df: DataFrame, kind: str, path: str, settings: Settings | DataFrame = DEFAULTS, **split) -> None:
    """Save a report and its summary lines as CSV files."""
    report(df, kind, settings, **split).write.mode("overwrite").option("header", True).csv(f"{path}/{kind}")
    report_summary(df, settings, **split).write.mode("overwrite").option("header", True).csv(f"{path}/{kind}_summary")
