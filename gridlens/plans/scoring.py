"""Training, saving and applying all models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, ORDER, Settings
from gridlens.functions.scalar import ensemble_score, fault_name, forest_score, is_anomaly, threshold_score
from gridlens.operators.anomaly import train_stats, with_zscore
from gridlens.operators.bagging import Bagged
from gridlens.operators.boosting import Boosted
from gridlens.operators.faults import confusion, stratified_split
from gridlens.operators.features import FEATURE_NAMES, sliding_features, windows_over
from gridlens.operators.forecaster import Forecaster, fit_forecaster
from gridlens.operators.forest import IsolationForest, fit_isolation_forest
from gridlens.operators.learn import Scaler, bounded_rows, fit_boosted, fit_random_forest, probabilities, vote
from gridlens.operators.ordered import ordered
from gridlens.session import materialize, share


@dataclass
class Models:
    scaler: Scaler
    detector: IsolationForest
    forest: Bagged
    boosted: Boosted
    stats: DataFrame
    forecaster: Forecaster


def training_windows(labelled: DataFrame, settings: Settings = DEFAULTS, label: str = "fault_label") -> DataFrame:
    """Labelled windows, bounded by ``settings.labelled_rows`` and written once, with ``is_test`` for the held-out share.

    Features are computed once, for what is written: labels are counted, and the split is found, on the rows that end a window.
    """
    size = settings.window
    series = ordered(labelled, KEYS, ORDER, behind=size - 1)
    ends = series.own(series.df).where(F.col("pos") >= size)
    windows = bounded_rows(windows_over(series, size, FEATURE_NAMES, settings), label, settings, counted=ends)
    counted = bounded_rows(ends, label, settings)
    return materialize(stratified_split(windows, settings.test_share, label, counted=counted), "training-windows")


def train(
    labelled: DataFrame,
    settings: Settings = DEFAULTS,
    trees: int | None = None,
    depth: int | None = None,
    rounds: int | None = None,
    label: str = "fault_label",
) -> Models:
    """Train all models on labelled readings; ``trees``, ``depth`` and ``rounds`` shrink them.

    The classifiers learn from the train part of the windows, the detector from its rows without a fault (all rows if there
    are none), the statistics and the forecaster from all readings.
    """
    windows = training_windows(labelled, settings, label).where("NOT is_test")
    return train_on(windows, labelled, settings, trees, depth, rounds, label)


def train_on(windows: DataFrame, labelled: DataFrame, settings: Settings = DEFAULTS, trees: int | None = None, depth: int | None = None, rounds: int | None = None, label: str = "fault_label") -> Models:
    scaler = Scaler.fit(windows, FEATURE_NAMES)
    scaled = scaler.transform(windows)
    sound = scaled.where(F.col(label) == 0)
    return Models(
        scaler,
        fit_isolation_forest(scaled if sound.isEmpty() else sound, FEATURE_NAMES, trees, settings),
        fit_random_forest(scaled, FEATURE_NAMES, label, trees, depth, settings),
        fit_boosted(scaled, FEATURE_NAMES, label, rounds, depth, settings),
        materialize(train_stats(labelled), "train-stats"),
        fit_forecaster(labelled, settings),
    )


def score_windows(windows: DataFrame, models: Models) -> DataFrame:
    """Isolation decision, fault, confidence and best labels of feature rows, in one pass; works on streams."""
    kept = [c for c in windows.columns if c not in FEATURE_NAMES]
    shared = share(windows.sparkSession, (models.scaler, models.detector, models.forest, models.boosted))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scaler, detector, forest, boosted = shared()
        for batch in batches:
            x = scaler.scaled(batch[list(FEATURE_NAMES)].to_numpy(float))
            yield batch[kept].assign(decision=detector.raw_scores(x) - detector.offset, rf=list(forest.probabilities(x)), gb=list(boosted.probabilities(x)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields if f.name in kept)
    return vote(windows.mapInPandas(score, f"{schema}, decision double, rf array<double>, gb array<double>"))


def score_readings(df: DataFrame, models: Models, settings: Settings = DEFAULTS, **split) -> DataFrame:
    """Scores, fault and both anomaly flags of each reading that completes a window.

    ``is_anomaly`` follows the ensemble of all methods, ``is_outlier`` the isolation forest alone.
    """
    windows = sliding_features(df, names=[*FEATURE_NAMES, "moving_avg"], settings=settings, **split).drop("pos")
    scored = score_windows(windows, models)
    scored = with_zscore(scored, models.stats, KEYS).withColumns(
        {
            "threshold": threshold_score(s=settings),
            "isolation_forest": forest_score("decision"),
            "served_score": forest_score("decision", capped=True),
        }
    )
    return scored.withColumn(
        "score", ensemble_score("threshold", "zscore", "isolation_forest", "moving_avg")
    ).withColumns(
        {
            "is_anomaly": is_anomaly("score", settings),
            "is_outlier": F.col("decision") < 0,
            "fault_name": fault_name("fault_id"),
        }
    )


def vote_confusion(labelled: DataFrame, settings: Settings = DEFAULTS, label: str = "fault_label", **options) -> DataFrame:
    """Rows per true and voted label on the held-out windows; ``faults`` makes metrics and reports of it."""
    windows = training_windows(labelled, settings, label)
    scaler = Scaler.fit(windows.where("NOT is_test"), FEATURE_NAMES)
    train, test = (scaler.transform(windows.where(part)) for part in ("NOT is_test", "is_test"))
    rounds, size = options.get("rounds"), {k: options.get(k) for k in ("trees", "depth")}
    forest = fit_random_forest(train, FEATURE_NAMES, label, settings=settings, **size)
    boosted = fit_boosted(train, FEATURE_NAMES, label, rounds, size["depth"], settings)
    return confusion(vote(probabilities(test, forest, boosted)), label)


def save(models: Models, spark: SparkSession, path: str) -> None:
    models.scaler.save(spark, f"{path}/scaler")
    models.detector.save(spark, f"{path}/detector")
    models.forest.save(spark, f"{path}/forest")
    models.boosted.save(spark, f"{path}/boosted")
    models.forecaster.save(spark, f"{path}/forecaster")
    models.stats.write.mode("overwrite").parquet(f"{path}/stats")
    # Written last: its presence says that the other parts are complete.
    spark.range(1).write.mode("overwrite").parquet(f"{path}/complete")


def load(spark: SparkSession, path: str) -> Models | None:
    """The saved models, or nothing unless all of them are there."""
    try:
        spark.read.parquet(f"{path}/complete")
        return Models(
            Scaler.load(spark, f"{path}/scaler"),
            IsolationForest.load(spark, f"{path}/detector"),
            Bagged.load(spark, f"{path}/forest"),
            Boosted.load(spark, f"{path}/boosted"),
            spark.read.parquet(f"{path}/stats"),
            Forecaster.load(spark, f"{path}/forecaster"),
        )
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def fit_or_load(spark: SparkSession, path: str, labelled: DataFrame, force: bool = False, **options) -> Models:
    """The saved models; without them, or with ``force``, new ones, which are saved."""
    found = None if force else load(spark, path)
    if found is None:
        found = train(labelled, **options)
        save(found, spark, path)
    return found
