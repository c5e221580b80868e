"""Records, alerts and the maintained tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, ORDER, Settings
from gridlens.functions.numeric import fixed, half_up
from gridlens.functions.scalar import fault_name, load_status3, log_level, percent_text
from gridlens.operators.ordered import latest, ordered
from gridlens.operators.settings import resolved
from gridlens.operators.settings import text as setting_text


def build_record(df: DataFrame, keys: Sequence[str] = KEYS, extra: Sequence[str] = ()) -> DataFrame:
    """Nested reading record with rounded values; ``extra`` columns are kept as they are."""
    return df.select(
        *keys,
        "seq",
        F.col("ts").alias("timestamp"),
        half_up("voltage", 2).alias("voltage"),
        half_up("current", 3).alias("current"),
        half_up("power", 2).alias("power"),
        half_up("energy_kwh", 6).alias("energy_kwh"),
        F.struct("is_anomaly", half_up("anomaly_score", 4).alias("score")).alias("anomaly"),
        F.struct(
            "fault_id",
            fault_name("fault_id").alias("fault_name"),
            half_up("confidence", 4).alias("confidence"),
        ).alias("fault"),
        F.struct(
            half_up("health_score", 1).alias("score"),
            F.coalesce("health_label", F.lit("Unknown")).alias("label"),
        ).alias("health"),
        *extra,
    )


def latest_reading(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Newest row of each device."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def every_nth(df: DataFrame, n: int = 5, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **split) -> DataFrame:
    """Each ``n``-th row of a device."""
    series = ordered(df, keys, order, **split)
    return series.own(series.df).filter(F.col("pos") % n == 0)


def retain_last(df: DataFrame, n: int = 500, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest ``n`` rows of each device, for pruning a table."""
    return latest(df, n, keys, order).drop("age")


def recent(df: DataFrame, n: int, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest ``n`` rows of the whole table, newest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def rolling_series(df: DataFrame, n: int = 80, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest ``n`` readings of each device with their position in the plot, from 0."""
    rows = latest(df, n, keys)
    shown = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("x", shown - F.col("age")).drop("age")


def alert_record(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """A record for each reading that is anomalous or has a fault."""
    faulty = F.col("fault_id") != 0
    by_fault = F.concat(fault_name("fault_id"), F.lit(" ("), percent_text("confidence"), F.lit(")"))
    by_score = F.concat(F.lit("Anomaly score="), fixed("anomaly_score", 3))
    return df.filter(F.col(flag) | faulty).select(
        "device_id",
        "seq",
        F.col("ts").alias("timestamp"),
        F.when(faulty, "fault").otherwise("anomaly").alias("type"),
        F.when(faulty, by_fault).otherwise(by_score).alias("detail"),
        F.when(F.col("fault_id").isin(3, 4), "critical").otherwise("warning").alias("severity"),
        half_up("voltage", 2).alias("voltage"),
        half_up("current", 3).alias("current"),
        half_up("power", 2).alias("power"),
    )


def _alert(no: int, kind: str, severity: str, when: Column, message: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(no).alias("alert_no"),
            F.lit(kind).alias("type"),
            message.alias("message"),
            F.lit(severity).alias("severity"),
        ),
    )


def _raised(df: DataFrame, alerts: list[Column]) -> DataFrame:
    found = F.filter(F.array(*alerts), lambda a: a.isNotNull())
    return df.select(*KEYS, *ORDER, F.inline(found))


def _threshold_rules(s: Settings) -> list[Column]:
    def text(label: str, value: Column, unit: str, word: str, limit: float | Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value, F.lit(f"{unit} ({word}: "), setting_text(limit), F.lit(f"{unit})"))

    v, i, p = F.col("voltage"), F.col("current"), F.col("power")
    # Alert types and texts.
    return [
        _alert(1, "overvoltage", "danger", v > s.voltage_high, text("⚡ OVERVOLTAGE", fixed(v, 1), "V", "limit", s.voltage_high)),
        _alert(2, "undervoltage", "danger", v < s.voltage_low, text("🔋 UNDERVOLTAGE", fixed(v, 1), "V", "min", s.voltage_low)),
        _alert(3, "overcurrent", "danger", i > s.current_max, text("🔥 OVERCURRENT", fixed(i, 2), "A", "limit", s.current_max)),
        _alert(4, "overload", "danger", p > s.power_max, text("💥 OVERLOAD", fixed(p, 0), "W", "limit", s.power_max)),
    ]


def _model_rules() -> list[Column]:
    score, sure = F.col("anomaly_score"), F.col("confidence")
    # Alert types and texts.
    anomaly = F.concat(F.lit("🔍 ANOMALY DETECTED (score: "), fixed(score, 2), F.lit(")"))
    fault = F.concat(
        F.lit("🛠️ FAULT: "), fault_name("fault_id"), F.lit(" (confidence: "), percent_text(sure), F.lit(")")
    )
    return [
        _alert(5, "anomaly", "warning", score > 0.7, anomaly),
        _alert(6, "fault", "warning", (F.col("fault_id") != 0) & (sure > 0.7), fault),
    ]


def threshold_alerts(df: DataFrame, settings: Settings | DataFrame = DEFAULTS) -> DataFrame:
    """An alert for each limit a reading is past."""
    df, s = resolved(df, settings)
    return _raised(df, _threshold_rules(s))


def model_alerts(df: DataFrame) -> DataFrame:
    """An alert for each high anomaly score and each confident fault."""
    return _raised(df, _model_rules())


def alerts(df: DataFrame, settings: Settings | DataFrame = DEFAULTS) -> DataFrame:
    df, s = resolved(df, settings)
    return _raised(df, _threshold_rules(s) + _model_rules())


def active_alerts(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Alerts of the newest reading of each device."""
    return alerts(latest_reading(df, keys), settings)


def alert_summary(raised: DataFrame, last_n: int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of the newest alerts per device: in all, by type and by severity."""
    rows = latest(raised, last_n, keys, (*ORDER, "alert_no"))
    key_cols = [F.col(k) for k in keys]
    t, s = F.col("type"), F.col("severity")
    counted = rows.groupingSets([[*key_cols, t], [*key_cols, s], key_cols], *key_cols, t, s).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("type").alias("_t"), F.grouping("severity").alias("_s")
    )
    by = F.when(F.col("_t") == 0, "type").when(F.col("_s") == 0, "severity").otherwise("total")
    value = F.coalesce(t, s, F.lit("all"))
    return counted.select(*keys, by.alias("by"), value.alias("value"), "n")


def reading_log(df: DataFrame, n: int = 20, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest ``n`` readings of each device as log lines; needs ``energy_kwh``."""
    rows, s = resolved(latest(df, n, keys), settings, keys)
    return rows.select(
        *keys,
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "ts",
        "seq",
        "voltage",
        "current",
        "power",
        half_up("energy_kwh", 4).alias("energy_kwh"),
        log_level(s=s).alias("status"),
        load_status3(s=s).alias("status_text"),
        F.lit(False).alias("is_alert"),
    )


def merge_alerts_into_log(
    log: DataFrame, records: DataFrame, newest: int = 10, cap: int = 200, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Put the newest alert records above the log lines, one per second and device.

    Alerts whose second the log already has an alert line for are left out. ``position`` counts
    from the top, where the oldest added alert stands; lines past ``cap`` fall off the end.
    """
    late = latest(records, newest, keys, ("timestamp", "seq"))
    late = late.withColumn("time", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    first = F.row_number().over(Window.partitionBy(*keys, "time").orderBy("age"))
    fresh = late.withColumn("_n", first).filter("_n = 1")
    fresh = fresh.join(log.filter("is_alert").select(*keys, "time"), [*keys, "time"], "left_anti")
    lines = fresh.select(
        *keys,
        "time",
        F.col("timestamp").alias("ts"),
        "seq",
        "voltage",
        "current",
        "power",
        F.when(F.col("severity") == "critical", "danger").otherwise("warning").alias("status"),
        F.substring(F.concat("type", F.lit(": "), F.coalesce("detail", F.lit(""))), 1, 40).alias("status_text"),
        F.lit(True).alias("is_alert"),
        (-F.col("age")).alias("_rank"),
        F.lit(0).alias("_part"),
    )
    newest_first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("seq").desc()))
    below = log.drop("energy_kwh").withColumns({"_rank": newest_first.cast("long"), "_part": F.lit(1)})
    top = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", "_rank"))
    return (
        lines.unionByName(below)
        .withColumn("position", top)
        .filter(F.col("position") <= cap)
        .drop("_rank", "_part")
    )
