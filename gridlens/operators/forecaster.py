"""The learned forecaster: a linear model per step ahead over the scaled rows of the lookback.

All steps share one table of products of inputs and targets. It is summed over batches of sorted rows, whose windows are never materialised, then
over tasks, and solved once: 3 * lookback inputs and a constant against ``horizon`` targets, whatever the number of readings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, ORDER, Settings
from gridlens.operators.features import _with_tail
from gridlens.operators.forecast import extend_forecast, fit_trend, forecast, minmax_scale, signal_ranges
from gridlens.operators.ordered import latest, ordered
from gridlens.session import materialize

SIGNALS = ("power", "voltage", "current")  # in the order of the inputs
TRAIN_SHARE = 0.85
PENALTY = 1e-3  # per sample, on all weights but the constant's


def window_parts(batches: Iterator[pd.DataFrame], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, targets and whether a sample is for training, for the samples that end in each batch of sorted, scaled rows."""
    back, ahead = settings.lookback, settings.horizon
    size = back + ahead
    for rows, new in _with_tail(batches, size - 1):
        pos = rows["pos"].to_numpy()
        ends = new[pos[new] >= size]
        if len(ends) == 0:
            continue
        windows = [sliding_window_view(rows[f"{s}_scaled"].to_numpy(float), size)[ends - size + 1] for s in SIGNALS]
        inputs = np.stack([w[:, :back] for w in windows], axis=2).reshape(len(ends), -1)
        samples = rows["_n"].to_numpy()[ends] - size + 1
        yield inputs, windows[0][:, back:], pos[ends] - size + 1 <= np.floor(samples * TRAIN_SHARE)


def with_constant(inputs: np.ndarray) -> np.ndarray:
    return np.column_stack([inputs, np.ones(len(inputs))])


def scaled_rows(df: DataFrame, ranges: DataFrame, settings: Settings, keys: Sequence[str], order: Sequence[str], **split) -> DataFrame:
    """Scaled readings in order, with their places and the rows of their device."""
    narrow = minmax_scale(df.select(*keys, *order, *SIGNALS), ranges, keys).drop(*SIGNALS)
    return ordered(narrow, keys, order, behind=settings.lookback + settings.horizon - 1, sizes=True, **split).sorted()


def products(rows: DataFrame, settings: Settings) -> np.ndarray:
    """Sums over all training samples of inputs times inputs and targets; the last input is the constant."""
    back, ahead = settings.lookback, settings.horizon
    width = 3 * back + 1

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + ahead))
        for inputs, targets, train in window_parts(batches, settings):
            x = with_constant(inputs[train])
            total += x.T @ np.column_stack([x, targets[train]])
        if total[-1, width - 1]:
            yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    # One number per cell: width * (width + horizon) rows, whatever the table.
    cells = rows.mapInPandas(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(width * (width + ahead))
    out[cells["cell"].to_numpy(dtype=int)] = cells["value"]
    return out.reshape(width, width + ahead)


@dataclass
class Forecaster:
    """Weights of every step, with what turns readings into inputs and results into watts."""

    weights: np.ndarray  # inputs and the constant by steps
    lookback: int
    horizon: int
    ranges: DataFrame  # of the signals of each device seen in training
    fits: DataFrame  # line and season of each device, for those with too few readings and beyond the horizon
    seasons: DataFrame

    def settings(self, base: Settings = DEFAULTS) -> Settings:
        return Settings(**{**base.__dict__, "lookback": self.lookback, "horizon": self.horizon})

    def forecast(self, df: DataFrame, steps: int | None = None, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS) -> DataFrame:
        """Watts expected at each of the next ``steps`` rows of each device, with the interval.

        The model is asked where a device is known and has ``lookback`` readings; others get line and season. Steps beyond the
        horizon go on along the line. The interval is that of the spread of the newest readings.
        """
        settings = self.settings(settings)
        steps = steps or self.horizon
        weights, back, horizon = self.weights, self.lookback, self.horizon
        newest = latest(df.select(*keys, *ORDER, *SIGNALS), back, keys)
        inputs = F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("at"), *[f"{s}_scaled" for s in SIGNALS])))
        rows = minmax_scale(newest, self.ranges, keys).groupBy(*keys).agg(inputs.alias("inputs")).where(F.size("inputs") == back)
        flat = F.flatten(F.transform("inputs", lambda x: F.array(*[x[f"{s}_scaled"] for s in SIGNALS])))

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = with_constant(np.stack(batch["inputs"].to_list())) @ weights
                yield batch.drop(columns="inputs").assign(scaled=list(found))

        kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
        scaled = rows.select(*keys, flat.alias("inputs")).mapInPandas(apply, f"{kinds}, scaled array<double>")
        width = F.col("power_high") - F.col("power_low")
        low = F.when(width == 0, F.lit(1.0)).otherwise(width)
        learned = (
            scaled.join(self.ranges, list(keys))
            .select(*keys, F.posexplode("scaled").alias("_at", "_value"), low.alias("_width"), "power_low")
            .select(*keys, (F.col("_at") + 1).alias("step"), (F.col("_value") * F.col("_width") + F.col("power_low")).alias("forecast"))
        )
        learned = extend_forecast(learned, self.fits, steps, settings, keys).withColumnRenamed("forecast", "_learned")
        plain = forecast(df, self.fits, self.seasons, steps, settings=settings, keys=keys, margins=True)
        expected = F.coalesce("_learned", "forecast")
        enough = F.col("margin").isNotNull()
        return plain.join(learned, [*keys, "step"], "left").select(
            *keys,
            "step",
            expected.alias("forecast"),
            F.when(enough, F.greatest(expected - F.col("margin"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("lower"),
            F.when(enough, expected + F.col("margin")).otherwise(F.lit(0.0)).alias("upper"),
            F.col("_learned").isNotNull().alias("is_learned"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n, [float(x) for x in r], self.lookback, self.horizon) for n, r in enumerate(self.weights)]
        spark.createDataFrame(rows, "input int, weights array<double>, lookback int, horizon int").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        for name in ("ranges", "fits", "seasons"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forecaster:
        rows = spark.read.parquet(f"{path}/weights").orderBy("input").collect()  # a row per input
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("ranges", "fits", "seasons")]
        return cls(np.array([r["weights"] for r in rows]), rows[0]["lookback"], rows[0]["horizon"], *tables)


def fit_forecaster(df: DataFrame, settings: Settings = DEFAULTS, penalty: float = PENALTY, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **split) -> Forecaster:
    """Fit all steps on the earlier 85 % of each device's samples."""
    ranges = materialize(signal_ranges(df, keys), "forecast-ranges")
    total = products(scaled_rows(df, ranges, settings, keys, order, **split), settings)
    width = 3 * settings.lookback + 1
    held = np.eye(width) * penalty * max(total[-1, width - 1], 1.0)
    held[-1, -1] = 0.0 if total[-1, width - 1] else 1.0
    weights = np.linalg.solve(total[:, :width] + held, total[:, width:])
    fits, seasons = (materialize(t, "forecast-fits") for t in fit_trend(df, keys, order, **split))
    return Forecaster(weights, settings.lookback, settings.horizon, ranges, fits, seasons)


def forecaster_metrics(df: DataFrame, model: Forecaster, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, **split) -> DataFrame:
    """Mean squared and absolute error of the scaled power over all steps of the held-out samples."""
    settings, weights = model.settings(), model.weights

    def misses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for inputs, targets, train in window_parts(batches, settings):
            miss = targets[~train] - with_constant(inputs[~train]) @ weights
            yield pd.DataFrame({"squares": [(miss**2).sum()], "sizes": [np.abs(miss).sum()], "n": [miss.size]})

    parts = scaled_rows(df, model.ranges, settings, keys, order, **split).mapInPandas(misses, "squares double, sizes double, n long")
    n = F.sum("n")
    return parts.agg((F.sum("squares") / n).alias("val_loss"), (F.sum("sizes") / n).alias("val_mae"), n.alias("n"))
