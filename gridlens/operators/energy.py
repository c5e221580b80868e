"""Energy, running statistics, peaks, sessions and load patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, ORDER, SIGNALS, Settings
from gridlens.functions.numeric import half_up, micros, sdiv
from gridlens.functions.scalar import load_status4
from gridlens.operators.ordered import Series, latest, ordered, running_sums
from gridlens.operators.settings import resolved


def _spread(columns: Sequence[str] = SIGNALS) -> list[Column]:
    return [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]


def signal_stats(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lowest, mean and highest value of each signal, and the number of readings."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), *_spread())


def recent_signal_stats(df: DataFrame, n: int = 80, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same over the newest ``n`` readings."""
    return signal_stats(latest(df, n, keys), keys)


def first_peak(value: str, ts: str = "ts", seq: str = "seq") -> tuple[Column, Column]:
    """Highest value and the first time it was reached; only values above zero count."""
    positive = F.when(F.col(value) > 0, F.col(value))
    at = F.min(F.when(F.col(value) > 0, F.struct(-F.col(value), F.col(ts), F.col(seq))))
    return F.coalesce(F.max(positive), F.lit(0.0)), at[ts]


def peaks(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Peak of each signal and when it was first reached."""
    out = []
    for s in SIGNALS:
        value, at = first_peak(s)
        out += [value.alias(f"peak_{s}"), at.alias(f"peak_{s}_time")]
    return df.groupBy(*keys).agg(*out)


def merge_session_peak(live: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Take over a stored session's power peak where it is above the live one."""
    old = stored.select(*keys, F.col("peak_power_w").alias("_w"), F.col("peak_power_time").alias("_t"))
    higher = F.coalesce(F.col("_w"), F.lit(0.0)) > F.col("peak_power")
    return live.join(old, list(keys), "left").withColumns(
        {
            "peak_power": F.when(higher, F.col("_w")).otherwise(F.col("peak_power")),
            "peak_power_time": F.when(higher, F.col("_t")).otherwise(F.col("peak_power_time")),
        }
    ).drop("_w", "_t")


def energy_step(series: Series) -> Column:
    """Energy since the previous reading in kWh: the reading's power held over that time."""
    seconds = (micros("ts") - F.lag(micros("ts")).over(series.window())) / F.lit(1e6)
    return F.coalesce(F.col("power") / 1000 * (seconds / 3600), F.lit(0.0))


def energy_steps(
    df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **split
) -> DataFrame:
    series = ordered(df, keys, order, behind=1, **split)
    return series.own(series.df.withColumn("kwh", energy_step(series)))


def power_columns(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """What energy figures need, so that nothing else is shuffled or written."""
    return df.select(*keys, *order, "power")


def running_energy(
    df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **split
) -> DataFrame:
    """Energy used by each device up to each reading, as ``energy_kwh``."""
    series = ordered(df, keys, order, behind=1, **split)
    stepped = series.df.withColumn("kwh", energy_step(series))
    return series.own(running_sums(series, stepped, {"energy_kwh": F.col("kwh")})).drop("kwh", "pos")


def energy_totals(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Energy, what it cost, and time span of each device."""
    hours = (F.max(micros("ts")) - F.min(micros("ts"))) / F.lit(1e6) / 3600
    steps, s = resolved(energy_steps(power_columns(df, keys), keys, **split), settings, keys)
    return steps.groupBy(*keys).agg(
        F.sum("kwh").alias("energy_kwh"),
        F.sum(F.col("kwh") * s.cost_per_kwh).alias("spent"),
        hours.alias("hours"),
        F.count(F.lit(1)).alias("samples"),
        F.max("ts").alias("last_ts"),
    )


def energy_report(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Energy, cost, power peak and present load status of each device."""
    peak, at = first_peak("power")
    steps, s = resolved(energy_steps(power_columns(df, keys), keys, **split), settings, keys)
    now = F.max_by(load_status4("power", s), F.struct(*ORDER))
    out = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("kwh").alias("energy_kwh"),
        F.sum(F.col("kwh") * s.cost_per_kwh).alias("spent"),
        peak.alias("peak_power"),
        at.alias("peak_power_time"),
        now.alias("load_status"),
    )
    return out.select(
        *keys,
        "samples",
        half_up("energy_kwh", 4).alias("energy_kwh"),
        half_up("spent", 2).alias("cost"),
        "peak_power",
        "peak_power_time",
        "load_status",
    )


# Upper bounds in watts of the load classes.
LOAD_CLASSES = [("idle", 50.0), ("light", 500.0), ("medium", 1500.0), ("heavy", None)]


def load_profile(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of readings per load class, in whole percent."""
    p, lower, parts = F.col("power"), None, []
    for name, upper in LOAD_CLASSES:
        inside = F.lit(True) if lower is None else p >= lower
        if upper is not None:
            inside = inside & (p < upper)
        share = F.count(F.when(inside, 1)) / F.count(F.lit(1)) * 100
        parts.append(half_up(share, 0).cast("int").alias(f"{name}_pct"))
        lower = upper
    return df.groupBy(*keys).agg(*parts)


def power_distribution(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean power per two-hour slot of the day: twelve rows per device, 0 for empty slots."""
    slot = F.floor(F.hour("ts") / 2)
    means = [
        F.struct(
            F.lit(k).alias("slot"),
            half_up(F.coalesce(F.avg(F.when(slot == k, F.col("power"))), F.lit(0.0)), 0).alias("avg_power"),
        )
        for k in range(12)
    ]
    return df.groupBy(*keys).agg(F.array(*means).alias("_s")).select(*keys, F.inline("_s"))


def energy_trend(df: DataFrame, days: int = 7, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Meter level at the end of each of the last ``days`` days with consumption."""
    daily = energy_steps(power_columns(df, keys), keys, **split).groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum("kwh").alias("_kwh"))
    # A row per device and day: levels are summed over days, not over readings.
    upto = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("energy_kwh", F.sum("_kwh").over(upto)).filter("energy_kwh <> 0").drop("_kwh")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("day").desc()))
    return (
        daily.withColumn("_n", newest)
        .filter(F.col("_n") <= days)
        .select(*keys, F.col("day").cast("string").alias("day"), half_up("energy_kwh", 4).alias("energy_kwh"))
    )


def energy_audit(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Energy and cost of the newest day, its week and month, and in total: a row per period."""
    steps, s = resolved(energy_steps(power_columns(df, keys), keys, **split), settings, keys)
    daily = steps.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum("kwh").alias("kwh"), F.sum(F.col("kwh") * s.cost_per_kwh).alias("spent"))
    daily = daily.withColumn("_last", F.max("day").over(Window.partitionBy(*keys)))
    sums = []
    for name, unit in (("today", "day"), ("week", "week"), ("month", "month"), ("total", None)):
        same = F.lit(True) if unit is None else F.date_trunc(unit, "day") == F.date_trunc(unit, "_last")
        kwh, spent = (F.coalesce(F.sum(F.when(same, F.col(c))), F.lit(0.0)).alias(c) for c in ("kwh", "spent"))
        sums.append(F.struct(F.lit(name).alias("period"), kwh, spent))
    rows = daily.groupBy(*keys).agg(F.array(*sums).alias("_p")).select(*keys, F.inline("_p"))
    return rows.select(*keys, "period", half_up("kwh", 4).alias("energy_kwh"), half_up("spent", 2).alias("cost"))


def _session_rows(df: DataFrame, gap_minutes: float, keys: Sequence[str], order: Sequence[str], **split) -> DataFrame:
    """Readings with the number of their session and the energy since the reading before in it.

    Sessions are numbered by a running count of gaps rather than a session window, because the
    latter sorts all rows of a device in one task.
    """
    series = ordered(power_columns(df, keys, order), keys, order, behind=1, **split)
    wait = micros("ts") - F.lag(micros("ts")).over(series.window())
    stepped = series.df.withColumn("_wait", wait)
    opens = F.when(F.col("_wait").isNull() | (F.col("_wait") > int(gap_minutes * 60_000_000)), 1).otherwise(0)
    numbered = series.own(running_sums(series, stepped.withColumn("_opens", opens), {"session_no": F.col("_opens")}))
    kwh = F.when(F.col("_opens") == 1, 0.0).otherwise(F.col("power") / 1000 * (F.col("_wait") / F.lit(1e6) / 3600))
    return numbered.withColumn("_kwh", kwh)


def session_summary(
    df: DataFrame, gap_minutes: float = 60, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **split
) -> DataFrame:
    """Sessions of each device, which end where no reading follows within the gap."""
    peak, at = first_peak("power")
    return _session_rows(df, gap_minutes, keys, order, **split).groupBy(*keys, "session_no").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("sample_count"),
        half_up(F.sum("_kwh"), 6).alias("energy_kwh"),
        half_up(peak, 2).alias("peak_power_w"),
        at.alias("peak_power_time"),
    )


def session_parts(df: DataFrame, gap_minutes: float = 60) -> DataFrame:
    """Sessions of some readings of each device, with what is needed to join them with those of other readings."""
    peak, at = first_peak("power")
    return _session_rows(df, gap_minutes, KEYS, ORDER).groupBy(*KEYS, "session_no").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("sample_count"),
        F.sum("_kwh").alias("kwh"),
        F.min_by("power", F.struct(*ORDER)).alias("first_power"),
        peak.alias("peak"),
        at.alias("peak_time"),
    ).drop("session_no")


def merge_sessions(parts: DataFrame, readings: DataFrame, gap_minutes: float = 60) -> DataFrame:
    """Sessions of all readings from parts of them, whatever order these came in.

    Parts that follow each other within the gap are one session, to which the time between them adds energy.
    Where parts of a device overlap in time, their sums do not add up, and that device's sessions are
    taken from its readings.
    """
    line = Window.partitionBy(*KEYS).orderBy("start_time", "end_time")
    reach = F.max("end_time").over(line.rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("_reach", reach).withColumn("_wait", micros("start_time") - micros("_reach"))
    mixed = placed.filter("_wait <= 0").select(*KEYS).distinct()
    apart = placed.join(mixed, list(KEYS), "left_anti")
    opens = F.when(F.col("_wait").isNull() | (F.col("_wait") > int(gap_minutes * 60_000_000)), 1).otherwise(0)
    between = F.when(F.col("_opens") == 1, 0.0).otherwise(F.col("first_power") / 1000 * (F.col("_wait") / F.lit(1e6) / 3600))
    numbered = apart.withColumn("_opens", opens).withColumns({"session_no": F.sum("_opens").over(line), "_kwh": F.col("kwh") + between})
    joined = numbered.groupBy(*KEYS, "session_no").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("sample_count").alias("sample_count"),
        half_up(F.sum("_kwh"), 6).alias("energy_kwh"),
        half_up(F.max("peak"), 2).alias("peak_power_w"),
        F.min(F.when(F.col("peak_time").isNotNull(), F.struct(-F.col("peak"), "peak_time")))["peak_time"].alias("peak_power_time"),
    )
    if mixed.isEmpty():
        return joined
    return joined.unionByName(session_summary(readings.join(mixed, list(KEYS), "left_semi"), gap_minutes))


def mean_power_factor(v: str, i: str, p: str, default: float = 0.0) -> Column:
    """Power factor of mean values."""
    apparent = F.col(v) * F.col(i)
    return F.when(apparent > 0, sdiv(p, apparent)).otherwise(F.lit(default))
