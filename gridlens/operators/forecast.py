"""Trend, season and forecast of power."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, ORDER, SIGNALS, Settings
from gridlens.functions.numeric import fixed
from gridlens.operators.ordered import latest, ordered


def signal_ranges(df: DataFrame, keys: Sequence[str] = KEYS, signals: Sequence[str] = SIGNALS) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[f(s).alias(f"{s}_{n}") for s in signals for n, f in (("low", F.min), ("high", F.max))]
    )


def _width(s: str) -> Column:
    width = F.col(f"{s}_high") - F.col(f"{s}_low")
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def minmax_scale(
    df: DataFrame, ranges: DataFrame, keys: Sequence[str] = KEYS, signals: Sequence[str] = SIGNALS
) -> DataFrame:
    """Each signal as ``<signal>_scaled`` between 0 and 1; one that never varies becomes 0."""
    scaled = {f"{s}_scaled": (F.col(s) - F.col(f"{s}_low")) / _width(s) for s in signals}
    return df.join(ranges, list(keys)).withColumns(scaled).drop(*[c for c in ranges.columns if c not in keys])


def minmax_restore(scaled: Column, signal: str = "power") -> Column:
    """The value behind a scaled one, next to the columns of ``signal_ranges``."""
    return scaled * _width(signal) + F.col(f"{signal}_low")


def chrono_split(
    df: DataFrame, share: float = 0.85, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **split
) -> DataFrame:
    """Mark the first ``share`` of each device's rows as ``is_train``."""
    series = ordered(df, keys, order, sizes=True, **split)
    return series.own(series.df).withColumn("is_train", F.col("pos") <= F.floor(F.col("_n") * share)).drop("_n")


def frame_sequences(
    df: DataFrame,
    settings: Settings = DEFAULTS,
    signals: Sequence[str] = ("power", "voltage", "current"),
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    **split,
) -> DataFrame:
    """Samples for learning: ``lookback`` rows of inputs and the power of the ``horizon`` rows after."""
    back, ahead = settings.lookback, settings.horizon
    series = ordered(df, keys, order, ahead=back + ahead - 1, **split)
    inputs = F.collect_list(F.struct(*signals)).over(series.rows(0, back - 1))
    targets = F.collect_list("power").over(series.rows(back, back + ahead - 1))
    return series.own(
        series.df.withColumns({"inputs": inputs, "targets": targets}).filter(F.size("targets") == ahead)
    )


def trend(df: DataFrame, n: int = 120, keys: Sequence[str] = KEYS) -> DataFrame:
    """Direction of the newest ``n`` power readings of each device."""
    rows = latest(df, n, keys)
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("power", -F.col("age").cast("double")).alias("slope"),
        F.avg(F.when(F.col("age") <= 10, F.col("power"))).alias("current_avg"),
    )
    known, slope = F.col("n") >= 10, F.coalesce(F.col("slope"), F.lit(0.0))
    calm = F.abs(slope) < 0.5
    rate = F.concat(fixed(F.abs(slope), 1), F.lit(" W/sample"))
    direction = (
        F.when(~known, "unknown").when(calm, "stable").when(slope > 0, "increasing").otherwise("decreasing")
    )
    text = (
        F.when(~known, "Insufficient data")
        .when(calm, "Power consumption is stable")
        .otherwise(F.concat(F.lit("Power consumption "), direction, F.lit(" at ~"), rate))
    )
    return found.select(
        *keys,
        direction.alias("direction"),
        F.when(known, slope).otherwise(F.lit(0.0)).alias("slope"),
        F.when(known, F.col("current_avg")).alias("current_avg"),
        text.alias("description"),
    )


def fit_trend(
    df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **split
) -> tuple[DataFrame, DataFrame]:
    """Line through each device's power over its row index, and its mean power per phase.

    The period is 60 rows or a third of the device's rows if that is less; only whole periods
    count, and a device needs more than 100 rows to have phases.
    """
    series = ordered(df.select(*keys, *order, "power"), keys, order, sizes=True, **split)
    # Each row knows its device's rows, so lines and phases are plain sums: no row meets the others of its device.
    period = F.when(F.col("_n") > 100, F.least(F.lit(60), F.floor(F.col("_n") / 3))).otherwise(0)
    rows = series.own(series.df).withColumns({"idx": F.col("pos") - 1, "_period": period})
    line = [f("power", F.col("idx").cast("double")) for f in (F.regr_slope, F.regr_intercept)]
    fits = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(line[0], F.lit(0.0)).alias("slope"),
        F.coalesce(line[1], F.avg("power")).alias("intercept"),
        F.max("_period").alias("period"),
    )
    whole = F.floor(F.col("_n") / F.col("_period")) * F.col("_period")
    seasons = (
        rows.filter((F.col("_period") > 0) & (F.col("idx") < whole))
        .groupBy(*keys, F.pmod("idx", "_period").alias("phase"))
        .agg(F.avg("power").alias("season"))
    )
    return fits, seasons


def forecast(
    df: DataFrame,
    fits: DataFrame,
    seasons: DataFrame,
    steps: int | None = None,
    origin: str = "buffer",
    settings: Settings = DEFAULTS,
    keys: Sequence[str] = KEYS,
    margins: bool = False,
) -> DataFrame:
    """Expected power of the next ``steps`` rows of each device with its 95 % interval.

    The line is read from the number of buffered rows on (``origin="buffer"``), or from the end
    of the whole series (``origin="series"``). Without a fit, the mean of the last ten rows is
    the forecast. With ``margins``, ``margin`` is half the interval's width, null where there are too few rows for one.
    """
    steps = steps or settings.horizon
    buffer = latest(df, 2 * settings.lookback, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("buffered"),
        F.avg(F.when(F.col("age") <= 10, F.col("power"))).alias("recent"),
        F.stddev_pop(F.when(F.col("age") <= 50, F.col("power"))).alias("spread"),
    )
    known = buffer.join(fits, list(keys), "left")
    start = F.col("buffered") if origin == "buffer" else F.coalesce(F.col("n"), F.col("buffered"))
    future = known.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn(
        "at", start + F.col("step") - 1
    )
    future = future.withColumn("phase", F.when(F.col("period") > 0, F.pmod("at", "period")))
    line = F.coalesce(F.col("slope") * F.col("at") + F.col("intercept"), F.col("recent"))
    mixed = F.when(F.col("season").isNotNull(), line * 0.6 + F.col("season") * 0.4).otherwise(line)
    expected = F.when(F.col("buffered") < 3, F.lit(0.0)).otherwise(F.greatest(mixed, F.lit(0.0)))
    enough = F.col("buffered") > 10
    margin = F.col("spread") * F.sqrt(F.col("step") / F.lit(steps)) * 1.96
    return future.join(seasons, [*keys, "phase"], "left").withColumn("forecast", expected).select(
        *keys,
        "step",
        "forecast",
        F.when(enough, F.greatest(F.col("forecast") - margin, F.lit(0.0))).otherwise(F.lit(0.0)).alias("lower"),
        F.when(enough, F.col("forecast") + margin).otherwise(F.lit(0.0)).alias("upper"),
        *([F.when(enough, margin).alias("margin")] if margins else []),
    )


def extend_forecast(
    predicted: DataFrame, fits: DataFrame, steps: int, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Carry a forecast past its horizon along the fitted slope, or flat without one."""
    horizon = settings.horizon
    near = predicted.filter(F.col("step") <= min(steps, horizon)).select(*keys, "step", "forecast")
    if steps <= horizon:
        return near
    far = (
        predicted.filter(F.col("step") == horizon)
        .join(fits.select(*keys, "slope"), list(keys), "left")
        .withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps - horizon))))
        .select(
            *keys,
            (F.col("_k") + horizon).alias("step"),
            (F.col("forecast") + F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("_k")).alias("forecast"),
        )
    )
    return near.unionByName(far)
