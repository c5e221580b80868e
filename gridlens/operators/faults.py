"""Fault labels: distributions, train and test parts, and quality of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.config import FAULT_NAMES, KEYS
from gridlens.functions.numeric import half_up, sdiv
from gridlens.functions.scalar import fault_name
from gridlens.operators.ordered import latest


def fault_distribution(df: DataFrame, last_n: int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """Faults among the newest predictions of each device, most common first as ``position``."""
    counted = (
        latest(df, last_n, keys).groupBy(*keys, fault_name("fault_id").alias("fault_name")).agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "fault_name")
    return counted.withColumn("position", F.row_number().over(order))


def recurring_fault(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most common fault of the newest 30 predictions, where more than 5 of them are faults and
    the device has more than 30 predictions."""
    counted = (
        latest(df, 31, keys)
        .groupBy(*keys, fault_name("fault_id").alias("fault_name"))
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(F.when((F.col("age") <= 30) & (F.col("fault_id") != 0), 1)).alias("times"),
        )
    )
    device = Window.partitionBy(*keys)
    best = F.row_number().over(device.orderBy(F.col("times").desc(), "fault_name"))
    return (
        counted.withColumns(
            {"_seen": F.sum("_rows").over(device), "_faults": F.sum("times").over(device), "_n": best}
        )
        .filter("_seen > 30 AND _faults > 5 AND _n = 1")
        .select(*keys, "fault_name", "times")
    )


def label_distribution(df: DataFrame, label: str = "fault_label") -> DataFrame:
    """Rows and percent per label; labels that do not occur are listed with 0."""
    ids = list(FAULT_NAMES)
    counts = df.agg(
        F.count(F.lit(1)).alias("_all"),
        F.array(
            *[
                F.struct(F.lit(k).alias("label"), F.count(F.when(F.col(label) == k, 1)).alias("n"))
                for k in ids
            ]
        ).alias("_l"),
    )
    return counts.select("_all", F.inline("_l")).select(
        "label",
        fault_name("label").alias("fault_name"),
        "n",
        half_up(sdiv(F.col("n") * 100, "_all"), 1).alias("percent"),
    )


MOST_LABELS = 10_000


def hash_rank(*key: str) -> Column:
    """A reproducible shuffle key: 32 bits of an MD5 digest, as a number; a null counts as an empty text."""
    text = F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _local(df: DataFrame) -> DataFrame:
    """A table with a row per label as local rows, which join without a shuffle of the other side."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def stratified_split(
    df: DataFrame, share: float = 0.2, label: str = "fault_label", key: Sequence[str] = ("device_id", "seq"), limit: int | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Mark the test part, the same share of each label, as ``is_test``.

    The test rows of a label are those with the lowest digests of ``key``, which is unique. Digests
    fall evenly into 2^20 ranges; row counts per range tell in which one a label's border lies, and
    only the rows of that range are ranked to find it. Marking the rows is then a comparison per row.
    ``limit`` has no effect: there is one way at every size. ``counted`` may have the labels and keys of the same rows where ``df`` is costly.
    """
    counted = df if counted is None else counted
    labels = counted.select(label).distinct().limit(MOST_LABELS + 1).count()
    # With more labels than that, the tables below stay distributed and Spark chooses the joins.
    local = _local if labels <= MOST_LABELS else lambda rows: rows
    place = F.struct(hash_rank(*key).alias("_h"), *key)
    coded = counted.select(F.col(label).alias("_label"), place.alias("_place")).withColumn("_range", F.shiftright("_place._h", 12))
    upto = Window.partitionBy("_label").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        coded.groupBy("_label", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy("_label"))})
        .withColumn("_take", F.floor(F.col("_all") * share + 0.5))
        .filter("_upto >= _take AND _upto - _n < _take")
        .select(F.col("_label").alias("_of"), F.col("_range").alias("_in"), (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_place"))
    borders = (
        coded.join(local(ranges), F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_rest"))
        .select(F.col("_label").alias("_of"), F.col("_place").alias("_border"))
    )
    placed = df.join(local(borders), F.col(label).eqNullSafe(F.col("_of")), "left")
    # A label whose share rounds to no rows has no border.
    return placed.withColumn("is_test", F.coalesce(place <= F.col("_border"), F.lit(False))).drop("_of", "_border")


def confusion(df: DataFrame, label: str = "fault_label", predicted: str = "fault_id") -> DataFrame:
    """Rows per true and predicted label."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """A row per true label and a column ``p<id>`` per predicted label."""
    ids = list(FAULT_NAMES)
    wide = counts.groupBy("label").pivot("predicted", ids).agg(F.sum("n"))
    return wide.select("label", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"p{k}") for k in ids])


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, 0 where undefined."""
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("pred_n"),
                         F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("pred_n"),
                         F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    per = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("true_n", "pred_n", "hits")])
    precision, recall = sdiv("hits", "pred_n"), sdiv("hits", "true_n")
    return per.select(
        "label",
        fault_name("label").alias("fault_name"),
        precision.alias("precision"),
        recall.alias("recall"),
        sdiv(precision * recall * 2, precision + recall).alias("f1"),
        F.col("true_n").alias("support"),
        "hits",
    )


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, in one row."""
    weight = F.sum("support")

    def weighted(c: str) -> Column:
        return sdiv(F.sum(F.col(c) * F.col("support")), weight).alias(f"{c}_weighted")

    return class_report(counts).agg(
        sdiv(F.sum("hits"), weight).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
        weight.alias("support"),
    )
