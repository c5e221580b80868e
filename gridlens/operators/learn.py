"""Scaling, fault classifiers and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, Settings
from gridlens.functions.scalar import predicted_class, predicted_confidence, soft_vote, top_classes
from gridlens.operators.bagging import Bagged, fit_random_forest, fold_of, grow_forests, prepared, with_probabilities
from gridlens.operators.binning import row_number
from gridlens.operators.boosting import Boosted, fit_boosted
from gridlens.session import share_for_now

__all__ = ["Scaler", "bounded_rows", "cross_validate", "feature_importance", "fit_boosted", "fit_random_forest", "probabilities", "vote"]


@dataclass
class Scaler:
    """Mean and population deviation per column; a column that never varies is only centred."""

    means: dict[str, float]
    stds: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, names: Sequence[str]) -> Scaler:
        vector = array_to_vector(F.array(*[F.col(c).cast("double") for c in names]))
        found = df.agg(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s")).first()["s"]
        population = (found["count"] - 1) / found["count"]  # the summary has sample variances
        stds = [(v * population) ** 0.5 for v in found["variance"].toArray().tolist()]
        means = found["mean"].toArray().tolist()
        return cls(dict(zip(names, means)), {c: s or 1.0 for c, s in zip(names, stds)})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.stds[c]) for c, m in self.means.items()})

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Rows whose columns are those of the scaler, in its order."""
        return (x - np.array(list(self.means.values()))) / np.array([self.stds[c] for c in self.means])

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, m, self.stds[c], n) for n, (c, m) in enumerate(self.means.items())]
        spark.createDataFrame(rows, "name string, mean double, std double, no int").coalesce(1).write.mode(
            "overwrite"
        ).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        rows = spark.read.parquet(path).orderBy("no").collect()  # a row per feature
        return cls({r["name"]: r["mean"] for r in rows}, {r["name"]: r["std"] for r in rows})


def label_counts(df: DataFrame, label: str = "fault_label") -> dict[int, int]:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # per label


def bounded_rows(
    df: DataFrame, label: str = "fault_label", settings: Settings = DEFAULTS, seed: int = 42, key: Sequence[str] = ("device_id", "seq"), counted: DataFrame | None = None
) -> DataFrame:
    """Labelled rows to train on: all, or about ``settings.labelled_rows``, as many of each label as there are and its part allows.

    A hash of the row decides, so the same rows are taken every time. ``counted`` may have the labels of the same rows where ``df`` is costly.
    """
    counts = label_counts((df if counted is None else counted).where(F.col(label).isNotNull()), label)
    part = settings.labelled_rows / max(len(counts), 1)
    shares = [F.when(F.col(label) == k, F.lit(min(1.0, part / n))) for k, n in counts.items()]
    drawn = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.where(drawn < F.coalesce(*shares, F.lit(0.0)))


def probabilities(df: DataFrame, forest: Bagged | None = None, boosted: Boosted | None = None) -> DataFrame:
    """Add ``rf`` and ``gb``, the probabilities of all label ids, from the models given; works on streams."""
    return with_probabilities(df, {k: m for k, m in (("rf", forest), ("gb", boosted)) if m is not None})


def vote(df: DataFrame, k: int = 3) -> DataFrame:
    """Fault id, confidence and best labels from the probabilities ``rf`` and ``gb``."""
    return (
        df.withColumn("_vote", soft_vote("rf", "gb"))
        .withColumns(
            {
                "fault_id": predicted_class("_vote"),
                "confidence": predicted_confidence("_vote"),
                "top": F.coalesce(top_classes("_vote", k), F.array().cast("array<struct<id:int,name:string,prob:double>>")),
            }
        )
        .drop("_vote", "rf", "gb")
    )


def fold_scores(
    df: DataFrame,
    names: Sequence[str],
    label: str = "fault_label",
    folds: int = 5,
    trees: int | None = None,
    depth: int | None = None,
    settings: Settings = DEFAULTS,
    seed: int = 42,
    key: Sequence[str] = ("device_id", "seq"),
) -> DataFrame:
    """Weighted F1 of the random forest on each fold's rows, by trees grown on the rows outside it.

    The trees of all folds grow in one pass. Each fold's rows are scored by a pass of their own, so that one forest at a time is shared.
    """
    rows, borders, counts = prepared(df, names, label, key)
    forests = grow_forests(rows, borders, counts, folds, trees or settings.trees, depth or settings.tree_depth, settings, seed)
    names = list(names)
    numbered = df.where(F.col(label).isNotNull()).withColumn("number", row_number(key))
    plain = numbered.select(fold_of(folds, seed).alias("fold"), F.col(label).cast("int").alias("label"), *names)
    counted = []
    for fold in range(folds):
        shared, done = share_for_now(df.sparkSession, forests.get(fold))

        def predict(batches):
            for batch in batches:
                forest = shared()  # noqa: B023
                best = forest.probabilities(batch[names].to_numpy(float)).argmax(axis=1) if forest else 0
                yield batch[["fold", "label"]].assign(predicted=best)

        found = plain.where(F.col("fold") == fold).mapInPandas(predict, "fold int, label int, predicted int")
        counted += found.groupBy("fold", "label", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per pair of labels
        done()
    forests.discard()
    counted = df.sparkSession.createDataFrame(counted, "fold int, label int, predicted int, n long")
    return f1_by(counted, "fold")


def f1_by(counted: DataFrame, group: str) -> DataFrame:
    """Support-weighted F1 of each group, from its rows per true and predicted label; 0 where undefined."""
    sides = counted.select(
        group,
        F.inline(
            F.array(
                F.struct(F.col("label").alias("of"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("said_n"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("predicted").alias("of"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("said_n"), F.lit(0).cast("long").alias("hits")),
            )
        ),
    )
    per = sides.groupBy(group, "of").agg(*[F.sum(c).alias(c) for c in ("true_n", "said_n", "hits")])
    return per.groupBy(group).agg((F.sum(F.col("true_n") * 2 * F.col("hits") / (F.col("true_n") + F.col("said_n"))) / F.sum("true_n")).alias("f1"))


def cross_validate(df: DataFrame, names: Sequence[str], label: str = "fault_label", folds: int = 5, **options) -> DataFrame:
    """Mean and deviation of the weighted F1 of the random forest over folds."""
    scores = fold_scores(df, names, label, folds, **options)
    return scores.agg(F.lit(folds).alias("folds"), F.avg("f1").alias("cv_mean"), F.stddev_pop("f1").alias("cv_std"))


def feature_importance(spark: SparkSession, model: Bagged, k: int = 10) -> DataFrame:
    """The ``k`` features the forest relies on most."""
    rows = [(n, float(x)) for n, x in zip(model.names, model.importances(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)
