"""Health scores, insights, recommendations, efficiency and cost, per device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, Settings
from gridlens.functions.numeric import clamp, fixed, half_up, sdiv
from gridlens.functions.scalar import health_color, health_label
from gridlens.operators.energy import energy_totals, mean_power_factor
from gridlens.operators.faults import recurring_fault
from gridlens.operators.ordered import latest
from gridlens.operators.settings import resolved, text

# Sizes of the history each figure looks at.
HISTORY = 3600
SCORES = 1000
SLOPE_ROWS = 60


def device_summary(
    df: DataFrame, history: int = HISTORY, keys: Sequence[str] = KEYS, score: str | None = "anomaly_score"
) -> DataFrame:
    """The figures all rules below are built on, over the newest readings of each device."""
    rows = latest(df, history, keys)
    newest = F.col("age") <= SLOPE_ROWS
    parts = [
        F.count(F.lit(1)).alias("n"),
        F.avg("voltage").alias("v_mean"),
        F.stddev_pop("voltage").alias("v_std"),
        F.avg("current").alias("i_mean"),
        F.max("current").alias("i_max"),
        F.avg("power").alias("p_mean"),
        F.stddev_pop("power").alias("p_std"),
        F.min("power").alias("p_min"),
        F.max("power").alias("p_max"),
        F.regr_slope(F.when(newest, F.col("power")), F.when(newest, -F.col("age").cast("double"))).alias("p_slope"),
    ]
    if score:
        scored = (F.col("age") <= SCORES) & F.col(score).isNotNull()
        parts += [
            F.count(F.when(scored, 1)).alias("scores"),
            F.avg(F.when(scored, F.when(F.col(score) > 0.3, 1.0).otherwise(0.0))).alias("anomalous"),
        ]
    out = rows.groupBy(*keys).agg(*parts)
    return out if score else out.withColumns({"scores": F.lit(0), "anomalous": F.lit(None).cast("double")})


def health_components(s: Settings = DEFAULTS) -> dict[str, Column]:
    """Component scores from 0 to 100 over the columns of ``device_summary``."""
    known = F.col("n") > 10
    zero = F.lit(0.0)

    deviation = F.abs(F.col("v_mean") - s.voltage_nominal) / s.voltage_nominal
    stability = clamp(F.lit(100.0) - F.col("v_std") * 10 - deviation * 200, 0, 100)

    use = F.col("i_max") / s.current_max
    safety = (
        F.when(use <= 0.7, F.lit(100.0))
        .when(use <= 0.85, 100 - (use - 0.7) * 200)
        .when(use <= 1.0, F.greatest(zero, 70 - (use - 0.85) * 400))
        .otherwise(F.greatest(zero, 10 - (use - 1.0) * 100))
    )

    load = F.col("p_mean") / s.power_max
    efficiency = F.when(load < 0.8, 100 - load * 30).otherwise(F.greatest(zero, 100 - load * 80))

    pf = mean_power_factor("v_mean", "i_mean", "p_mean")
    factor = (
        F.when(pf >= 0.95, F.lit(100.0))
        .when(pf >= 0.85, 80 + (pf - 0.85) * 200)
        .when(pf >= 0.7, 40 + (pf - 0.7) * 267)
        .otherwise(F.greatest(zero, pf * 57))
    )

    rate = F.when(F.col("scores") > 10, F.greatest(zero, 100 - F.col("anomalous") * 200)).otherwise(F.lit(80.0))

    slope = F.coalesce(F.col("p_slope"), zero)
    trend = (
        F.when(F.abs(slope) < 1, F.lit(90.0)).when(slope < 0, F.lit(95.0)).otherwise(F.greatest(zero, 80 - slope * 5))
    )

    def gated(x: Column) -> Column:
        return F.when(known, x).otherwise(F.lit(50.0))

    return {
        "voltage_stability": gated(stability),
        "current_safety": gated(safety),
        "power_efficiency": gated(efficiency),
        "anomaly_rate": rate,
        "power_factor": gated(factor),
        "energy_trend": F.when(F.col("n") > SLOPE_ROWS, trend).otherwise(F.lit(70.0)),
    }


def health_score(summary: DataFrame, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Components, their weighted total and its label and colour."""
    scored = summary.select(*keys, *[c.alias(name) for name, c in health_components(settings).items()])
    total = sum((F.col(c) * w for c, w in settings.health_weights.items()), F.lit(0.0))
    return scored.withColumn("_total", total).select(
        *keys,
        *settings.health_weights,
        half_up("_total", 1).alias("overall_score"),
        health_label("_total").alias("label"),
        health_color("_total").alias("color"),
    )


def health_struct(scored: DataFrame, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same with components and weights as maps."""
    names = list(settings.health_weights)
    components = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*names))
    weights = F.map_from_arrays(
        F.array(*[F.lit(c) for c in names]), F.array(*[F.lit(w) for w in settings.health_weights.values()])
    )
    return scored.select(
        *keys, "overall_score", "label", "color", components.alias("components"), weights.alias("weights")
    )


def cost_projection(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cost so far and at that rate per hour, day and month, from ``energy_totals``."""
    spent = F.col("spent")
    hourly = spent / F.col("hours")
    return totals.filter((F.col("energy_kwh") > 0) & (F.col("hours") > 0)).select(
        *keys,
        half_up("energy_kwh", 4).alias("energy_kwh"),
        half_up(spent, 2).alias("cost"),
        half_up(hourly, 4).alias("hourly_cost"),
        half_up(hourly * 24, 2).alias("daily_cost"),
        half_up(hourly * 24 * 30, 2).alias("monthly_cost"),
    )


def _facts(df: DataFrame, settings: Settings | DataFrame, keys: Sequence[str], **options) -> tuple[DataFrame, Settings]:
    """Summary and totals of each device, and the settings in force at its newest reading."""
    score = {k: options.pop(k) for k in ("score",) if k in options}
    both = device_summary(df, keys=keys, **score).join(energy_totals(df, settings, keys, **options), list(keys))
    return resolved(both, settings, keys, at="last_ts")


def efficiency_report(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Efficiency figures of each device with at least 60 readings; the others only have a status."""
    facts, s = _facts(df, settings, keys, score=None, **split)
    return facts.select(*keys, *efficiency_columns(s))


def efficiency_with_advice(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """The same with the titles of the recommendations in one text, from the same figures."""
    facts, s = _facts(df, settings, keys, score=None, **split)
    titles = F.array_join(F.transform(advice(s), lambda a: a["title"]), "; ")
    return facts.select(*keys, *efficiency_columns(s), titles.alias("recommendations"))


def efficiency_columns(s: Settings) -> list[Column]:
    """Status and figures over the columns of summary and totals."""
    p, ready = F.col("p_mean"), F.col("samples") >= 60
    figures = {
        "session_duration_hours": half_up("hours", 2),
        "total_energy_kwh": half_up("energy_kwh", 4),
        "total_cost": half_up("spent", 2),
        "avg_power_w": half_up(p, 1),
        "peak_power_w": half_up("p_max", 1),
        "min_power_w": half_up("p_min", 1),
        "power_factor": half_up(mean_power_factor("v_mean", "i_mean", "p_mean"), 3),
        "load_utilization_pct": half_up(p / s.power_max * 100, 1),
        "voltage_stability": half_up(100 - F.col("v_std") * 10, 1),
        "projected_daily_kwh": half_up(p * 24 / 1000, 2),
        "projected_monthly_cost": half_up(p * 24 * 30 / 1000 * s.cost_per_kwh, 2),
        "currency": text(s.currency),
    }
    status = F.when(ready, "ready").otherwise("insufficient_data").alias("status")
    return [status, *[F.when(ready, c).alias(name) for name, c in figures.items()]]


def _finding(no: int, when: Column, category: str, title, severity: str, text: Column) -> Column:
    title = F.lit(title) if isinstance(title, str) else title
    return F.when(
        when,
        F.struct(
            F.lit(no).alias("rule"),
            F.lit(category).alias("category"),
            title.alias("title"),
            F.lit(severity).alias("severity"),
            text.alias("description"),
        ),
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def insights(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """What stands out about each device, in the order of the rules."""
    facts, s = _facts(df, settings, keys, **split)
    facts = facts.join(recurring_fault(df, keys=keys), list(keys), "left")
    n, vm, vs, im = F.col("n"), F.col("v_mean"), F.col("v_std"), F.col("i_max")
    pm, px = F.col("p_mean"), F.col("p_max")
    load = pm / s.power_max * 100
    pf = mean_power_factor("v_mean", "i_mean", "p_mean")
    kwh, hours = F.col("energy_kwh"), F.col("hours")
    spent = F.col("spent")
    seen, common = n > 20, F.coalesce(F.col("fault_name"), F.lit(""))
    high, low = vm > s.voltage_high, vm < s.voltage_low
    over, near = im > s.current_max, im > s.current_max * 0.85
    past, busy = px > s.power_max, load > 70
    # Category, title and severity of each insight.
    rules = [
        _finding(1, seen & high, "voltage", "High Voltage Detected", "danger", _text("Mean voltage ", fixed(vm, 1), " V is above the limit.")),
        _finding(2, seen & low, "voltage", "Low Voltage Alert", "danger", _text("Mean voltage ", fixed(vm, 1), " V is below the limit.")),
        _finding(3, seen & ~high & ~low & (vs > 5), "voltage", "Voltage Instability", "warning", _text("Voltage deviates by ", fixed(vs, 1), " V.")),
        _finding(4, seen & ~high & ~low & (vs <= 5), "voltage", "Voltage Stable", "success", _text("Mean voltage is ", fixed(vm, 1), " V.")),
        _finding(5, seen & over, "current", "Overcurrent Detected", "danger", _text("Peak current ", fixed(im, 2), " A is above the limit.")),
        _finding(6, seen & ~over & near, "current", "Current Near Limit", "warning", _text("Peak current is ", fixed(im / s.current_max * 100, 0), "% of the limit.")),
        _finding(7, seen & past, "power", "Power Overload!", "danger", _text("Peak power ", fixed(px, 0), " W is above the rating.")),
        _finding(8, seen & ~past & busy, "power", "High Power Usage", "warning", _text("Mean load is ", fixed(load, 0), "% of the rating.")),
        _finding(9, seen & ~past & ~busy, "power", "Normal Power Usage", "success", _text("Mean load is ", fixed(load, 0), "% of the rating.")),
        _finding(10, seen & (pf < 0.7), "efficiency", "Poor Power Factor", "warning", _text("Power factor is ", fixed(pf, 3), ".")),
        _finding(11, seen & (pf >= 0.7) & (pf < 0.85), "efficiency", "Moderate Power Factor", "info", _text("Power factor is ", fixed(pf, 3), ".")),
        _finding(12, (F.col("scores") > 50) & (F.col("anomalous") > 0.1), "anomaly", "Frequent Anomalies Detected", "warning", _text(fixed(F.col("anomalous") * 100, 1), "% of readings are anomalous.")),
        _finding(13, F.col("fault_name").isNotNull(), "fault", _text("Recurring Fault: ", common), "warning", _text(common, " was seen ", F.coalesce(F.col("times").cast("string"), F.lit("0")), " times lately.")),
        _finding(14, (kwh > 0) & (hours > 0), "cost", "Energy Cost Analysis", "info", _text("Used ", fixed(kwh, 4), " kWh (", text(s.currency), fixed(spent, 2), "), ", text(s.currency), fixed(sdiv(spent, hours) * 24, 2), " a day.")),
    ]
    waiting = _finding(0, F.lit(True), "info", "Collecting Data", "info", F.lit("Too few readings yet."))
    raised = F.when(F.col("samples") < 10, F.array(waiting)).otherwise(F.filter(F.array(*rules), lambda r: r.isNotNull()))
    return facts.select(*keys, F.inline(raised))


def recommendations(df: DataFrame, settings: Settings | DataFrame = DEFAULTS, keys: Sequence[str] = KEYS, **split) -> DataFrame:
    """Advice for each device; ``position`` orders it by priority, then by rule."""
    facts, s = _facts(df, settings, keys, score=None, **split)
    return advise(facts, s, keys)


def advise(facts: DataFrame, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS) -> DataFrame:
    return facts.select(*keys, F.posexplode(advice(settings)).alias("position", "_r")).select(
        *keys, (F.col("position") + 1).alias("position"), "_r.priority", "_r.title", "_r.category", "_r.action"
    )


def advice(s: Settings = DEFAULTS) -> Column:
    """Recommendations over the columns of summary and totals, by priority, then by rule."""
    n, vm, vs, pm = F.col("n"), F.col("v_mean"), F.col("v_std"), F.col("p_mean")
    pf = mean_power_factor("v_mean", "i_mean", "p_mean", default=1.0)

    def rule(no: int, when: Column, priority: int, title: str, category: str, action: Column) -> Column:
        names = ("high", "medium", "low")
        return F.when(
            when,
            F.struct(
                F.lit(priority).alias("rank"),
                F.lit(no).alias("rule"),
                F.lit(names[priority]).alias("priority"),
                F.lit(title).alias("title"),
                F.lit(category).alias("category"),
                action.alias("action"),
            ),
        )

    # Title, priority and category of each recommendation.
    rules = [
        rule(1, (n > 30) & ((vm > s.voltage_high) | (vm < s.voltage_low)), 0, "Install Voltage Stabilizer", "hardware", _text("Regulate the supply; its mean is ", fixed(vm, 1), " V.")),
        rule(2, (n > 30) & (vs > 8), 1, "Investigate Voltage Fluctuations", "maintenance", F.lit("Check connections and nearby heavy loads.")),
        rule(3, (n > 60) & (pm / s.power_max > 0.7), 0, "Reduce Peak Load", "optimization", F.lit("Move large appliances to other circuits or hours.")),
        rule(4, (n > 60) & (F.col("p_std") > pm * 0.5), 1, "Stabilize Load Profile", "optimization", F.lit("Stagger large appliances to flatten the load.")),
        rule(5, (n > 30) & (pf < 0.85), 1, "Improve Power Factor", "efficiency", _text("Correct the power factor of ", fixed(pf, 3), ".")),
        rule(6, F.col("energy_kwh") > 0.01, 2, "Energy Saving Tips", "savings", F.lit("Prefer efficient devices and off-peak hours.")),
    ]
    waiting = rule(0, F.lit(True), 2, "Gathering Data", "info", F.lit("Too few readings yet."))
    found = F.array_sort(F.filter(F.array(*rules), lambda r: r.isNotNull()))
    return F.when(F.col("samples") < 30, F.array(waiting)).otherwise(found)
