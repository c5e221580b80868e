"""Per-reading expressions. Arguments are columns or column names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlens.config import (
    DEFAULTS,
    FAULT_NAMES,
    FAULT_SEVERITY,
    HEALTH_BANDS,
    HEALTH_COLORS3,
    HEALTH_COLORS3_FLOOR,
    HEALTH_FLOOR,
    Settings,
)
from gridlens.functions.numeric import col, fixed, half_up, sdiv


def power_factor(v="voltage", i="current", p="power", default: float = 0.0) -> Column:
    apparent = col(v) * col(i)
    return F.when(apparent > 0, sdiv(p, apparent)).otherwise(F.lit(default))


def reactive_power(v="voltage", i="current", p="power") -> Column:
    apparent = col(v) * col(i)
    return F.sqrt(F.greatest(apparent * apparent - col(p) * col(p), F.lit(0.0)))


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def point_features(s: Settings = DEFAULTS) -> dict[str, Column]:
    """Features of a single reading, for use with ``withColumns``."""
    v, i, p = F.col("voltage"), F.col("current"), F.col("power")
    return {
        "voltage_deviation_pct": F.abs(v - s.voltage_nominal) / s.voltage_nominal * 100,
        "current_load_pct": i / s.current_max * 100,
        "power_load_pct": p / s.power_max * 100,
        "apparent_power": v * i,
        "power_factor": power_factor(),
        "reactive_power": reactive_power(),
        "is_voltage_in_range": _flag(v.between(s.voltage_low, s.voltage_high)),
        "is_current_safe": _flag(i <= s.current_max),
        "is_power_safe": _flag(p <= s.power_max),
    }


def load_status4(p="power", s: Settings = DEFAULTS) -> Column:
    p = col(p)
    return (
        F.when(p > s.power_max, "OVERLOAD!")
        .when(p > s.power_max * 0.7, "HIGH LOAD")
        .when(p > s.power_max * 0.3, "NORMAL")
        .otherwise("LIGHT")
    )


def load_status3(p="power", s: Settings = DEFAULTS) -> Column:
    """Status text of the log table."""
    p = col(p)
    return F.when(p > s.power_max, "Overload").when(p > s.power_max * 0.7, "High").otherwise("Normal")


def log_level(p="power", s: Settings = DEFAULTS) -> Column:
    p = col(p)
    return F.when(p > s.power_max, "danger").when(p > s.power_max * 0.7, "warning").otherwise("normal")


def gauge_ratio(x, top: float) -> Column:
    """Share of a gauge that is filled."""
    if top <= 0:
        return F.lit(0.0)
    return F.when(col(x).isNotNull(), F.least(col(x) / F.lit(float(top)), F.lit(1.0)))


def threshold_score(v="voltage", i="current", p="power", s: Settings = DEFAULTS) -> Column:
    """How far past the limits a reading is, from 0 to 1."""
    v, i, p = col(v), col(i), col(p)
    one = F.lit(1.0)
    volts = (
        F.when(v > s.voltage_high, F.least((v - s.voltage_high) / (s.voltage_high * 0.1), one) * 0.4)
        .when(v < s.voltage_low, F.least((s.voltage_low - v) / (s.voltage_low * 0.1), one) * 0.4)
        .otherwise(F.lit(0.0))
    )
    amps = F.when(i > s.current_max, F.least((i - s.current_max) / (s.current_max * 0.2), one) * 0.3).otherwise(
        F.lit(0.0)
    )
    watts = F.when(p > s.power_max, F.least((p - s.power_max) / (s.power_max * 0.2), one) * 0.3).otherwise(
        F.lit(0.0)
    )
    return F.least(volts + amps + watts, one)


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def fault_name(fault_id="fault_id", default: str = "Unknown") -> Column:
    return F.coalesce(F.try_element_at(_lookup(FAULT_NAMES), col(fault_id).cast("int")), F.lit(default))


def fault_title(fault_id="fault_id") -> Column:
    """Name of a fault; ids without one are spelled out."""
    unknown = F.format_string("Unknown Fault (%d)", col(fault_id).cast("int"))
    named = F.try_element_at(_lookup(FAULT_NAMES), col(fault_id).cast("int"))
    return F.coalesce(named, unknown)


def fault_severity(fault_id="fault_id") -> Column:
    by_id = {k: FAULT_SEVERITY[name] for k, name in FAULT_NAMES.items()}
    return F.coalesce(F.try_element_at(_lookup(by_id), col(fault_id).cast("int")), F.lit(0))


def health_label(score) -> Column:
    out = F
    for lowest, label, _ in HEALTH_BANDS:
        out = out.when(col(score) >= lowest, label)
    return out.otherwise(HEALTH_FLOOR[0])


def health_color(score) -> Column:
    out = F
    for lowest, _, color in HEALTH_BANDS:
        out = out.when(col(score) >= lowest, color)
    return out.otherwise(HEALTH_FLOOR[1])


def health_color3(score) -> Column:
    out = F
    for lowest, color in HEALTH_COLORS3:
        out = out.when(col(score) >= lowest, color)
    return out.otherwise(HEALTH_COLORS3_FLOOR)


def forest_score(decision, capped: bool = False) -> Column:
    """Anomaly score of a decision value, which is negative for anomalies."""
    score = F.greatest(F.lit(0.0), -col(decision))
    return F.least(score, F.lit(1.0)) if capped else score


def ensemble_score(threshold, zscore, forest, moving_average) -> Column:
    return col(threshold) * 0.30 + col(zscore) * 0.25 + col(forest) * 0.30 + col(moving_average) * 0.15


def is_anomaly(score, s: Settings = DEFAULTS) -> Column:
    return col(score) > F.lit(1.0 - s.sensitivity)


def soft_vote(forest, boosted) -> Column:
    """Weighted mean of two probability arrays; one alone counts in full, the shorter sets the length."""
    a, b = col(forest), col(boosted)
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * 0.55 + y * 0.45)
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))


def top_classes(probabilities, k: int = 3) -> Column:
    """The ``k`` most probable classes as (id, name, prob); of equals, the larger id first."""
    pairs = F.transform(col(probabilities), lambda x, j: F.struct(x.alias("prob"), j.alias("id")))
    best = F.slice(F.reverse(F.array_sort(pairs)), 1, k)
    return F.transform(
        best,
        lambda c: F.struct(
            c["id"].alias("id"),
            F.coalesce(
                F.try_element_at(_lookup(FAULT_NAMES), c["id"]), F.concat(F.lit("Unknown_"), c["id"].cast("string"))
            ).alias("name"),
            c["prob"].alias("prob"),
        ),
    )


def predicted_class(probabilities) -> Column:
    """Position of the largest probability, the first on a tie; 0 without probabilities."""
    p = col(probabilities)
    return F.coalesce((F.array_position(p, F.array_max(p)) - 1).cast("int"), F.lit(0))


def predicted_confidence(probabilities) -> Column:
    return F.coalesce(F.array_max(col(probabilities)), F.lit(1.0))


def cost(kwh, rate: float | None = None, s: Settings = DEFAULTS) -> Column:
    return half_up(col(kwh) * F.lit(s.cost_per_kwh if rate is None else rate), 2)


def duration_hms(seconds) -> dict[str, Column]:
    """Whole hours, minutes and seconds, and the text shown for them."""
    t = F.floor(col(seconds))
    h, m, s = F.floor(t / 3600), F.floor(F.pmod(t, F.lit(3600)) / 60), F.pmod(t, F.lit(60))
    return {
        "hours": h,
        "minutes": m,
        "seconds": s,
        "uptime": F.format_string("%dh %dm", h, m),
    }


def percent_text(share) -> Column:
    return F.concat(fixed(col(share) * 100, 0), F.lit("%"))
