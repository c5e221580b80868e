"""Anomaly scores and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, ORDER, SIGNALS, Settings
from gridlens.functions.numeric import fixed
from gridlens.functions.scalar import ensemble_score, is_anomaly, threshold_score
from gridlens.operators.features import moving_average_scores
from gridlens.operators.ordered import latest
from gridlens.operators.settings import resolved


def train_stats(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and population deviation of each signal."""
    parts = [f(s).alias(f"{s}_{n}") for s in SIGNALS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*keys).agg(*parts)


def _deviations() -> dict[str, Column]:
    """Distance of each signal from its mean, in deviations; null where it never varied."""
    return {
        s: F.when(F.col(f"{s}_std") > 0, F.abs(F.col(s) - F.col(f"{s}_mean")) / F.col(f"{s}_std"))
        for s in SIGNALS
    }


def zscore_score() -> Column:
    """Mean over the signals of their distance from the mean, four deviations counting as 1."""
    parts = [F.when(z.isNotNull(), F.least(z / 4.0, F.lit(1.0))) for z in _deviations().values()]
    found = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    summed = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(found > 0, summed / found).otherwise(F.lit(0.0))


def _with_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings with the figures of ``train_stats``, null for a device without any."""
    if keys:
        return df.join(stats, list(keys), "left")
    whole = stats.first()  # one row for the whole table
    return df.withColumns({c: F.lit(whole[c]).cast("double") for c in stats.columns})


def with_zscore(df: DataFrame, stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``zscore``; without ``keys``, ``stats`` has one row for all devices."""
    scored = _with_stats(df, stats, keys).withColumn("zscore", zscore_score())
    return scored.drop(*[c for c in stats.columns if c not in keys])


def zscore_alerts(df: DataFrame, stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row for each signal more than two deviations from its mean."""
    found = []
    for s, z in _deviations().items():
        level = F.when(z > 3, "extreme").when(z > 2, "high")
        text = F.concat(F.lit(f"{s.title()} Z-score: "), fixed(z, 2), F.lit(" ("), level, F.lit(")"))
        found.append(
            F.when(level.isNotNull(), F.struct(F.lit(s).alias("signal"), level.alias("level"), text.alias("message")))
        )
    raised = F.filter(F.array(*found), lambda a: a.isNotNull())
    kept = df.columns
    return _with_stats(df, stats, keys).select(*kept, F.inline(raised))


def detect(
    df: DataFrame,
    stats: DataFrame,
    forest: Column | None = None,
    settings: Settings | DataFrame = DEFAULTS,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    stat_keys: Sequence[str] = KEYS,
    **split,
) -> DataFrame:
    """Ensemble anomaly score of each reading, with the score of each method.

    ``forest`` is the isolation-forest score where one is known, else that method counts 0.
    ``stat_keys`` are the keys ``stats`` was made with, none for one row over all devices.
    """
    fleet = settings if isinstance(settings, Settings) else DEFAULTS
    scored = moving_average_scores(df, fleet, keys, order, **split).drop("pos")
    scored, limits = resolved(scored, settings, keys)
    scored = with_zscore(scored, stats, stat_keys).withColumns(
        {
            "threshold": threshold_score(s=limits),
            "isolation_forest": F.lit(0.0) if forest is None else forest,
        }
    )
    return scored.withColumn(
        "score", ensemble_score("threshold", "zscore", "isolation_forest", "moving_avg")
    ).withColumn("is_anomaly", is_anomaly("score", fleet)).drop("settings")


def anomaly_rate(df: DataFrame, last_n: int = 100, flag: str = "is_anomaly", keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of anomalies among the newest readings of each device."""
    share = F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))
    return latest(df, last_n, keys).groupBy(*keys).agg(F.coalesce(share, F.lit(0.0)).alias("anomaly_rate"))
