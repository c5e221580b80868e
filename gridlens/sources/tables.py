"""Input shapes of the engine, derived from the event and line-item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.numeric import half_up


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_readings(events: DataFrame, devices: int | None = None) -> DataFrame:
    """One reading per event; ``devices`` folds users into that many coarser devices."""
    device = F.col("user_id") if devices is None else F.col("user_id") % F.lit(devices)
    return events.select(
        device.alias("device_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.expr("CAST(round(190 + 0.7 * CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), 2) AS DOUBLE)").alias(
            "voltage"
        ),
        F.round(F.col("value") / 10, 3).alias("current"),
    ).withColumn(
        "power",
        half_up(F.col("voltage") * F.col("current") * (0.60 + 0.004 * (F.col("seq") % 100)), 2),
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return as_readings(table(spark, folder, "events"))


def readings_coarse(spark: SparkSession, folder: str) -> DataFrame:
    return as_readings(table(spark, folder, "events"), devices=10)


def labelled(df: DataFrame) -> DataFrame:
    """Readings with the fault label their values imply."""
    v, i, p = F.col("voltage"), F.col("current"), F.col("power")
    return df.withColumn(
        "fault_label",
        F.when(p > 3000, 4)
        .when(i > 15, 3)
        .when(v > 250, 1)
        .when(v < 200, 2)
        .when(p < 0.7 * v * i, 7)
        .when(v >= 241.5, 6)
        .when(v <= 211.6, 5)
        .otherwise(0),
    )


def predictions(df: DataFrame) -> DataFrame:
    """Labelled readings with a fault prediction, its confidence and an anomaly score."""
    seq = F.col("seq")
    return labelled(df).withColumns(
        {
            "fault_id": F.when(seq % 7 == 0, (F.col("fault_label") + 1) % 10).otherwise(F.col("fault_label")),
            "confidence": (seq % 100).cast("double") / 100,
            "anomaly_score": (seq % 41).cast("double") / 50,
        }
    )


def inference_log(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        (F.col("user_id") % 10).alias("device_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind == "click", "anomaly_detector").when(kind == "view", "fault_rf").otherwise("fault_gb").alias("model"),
        F.round(F.col("value") / 10, 3).alias("latency_ms"),
        F.when(kind == "error", 1).otherwise(0).alias("is_error"),
    )


def sensor_lines(spark: SparkSession, folder: str) -> DataFrame:
    seq = F.col("seq")
    v, i = F.col("voltage").cast("string"), F.col("current").cast("string")
    return readings(spark, folder).select(
        "seq",
        F.when(seq % 17 == 0, "noise")
        .when(seq % 23 == 0, F.concat(v, F.lit(",")))
        .otherwise(F.concat(v, F.lit(","), i))
        .alias("value"),
    )


def adc_samples(spark: SparkSession, folder: str) -> DataFrame:
    return as_adc_samples(table(spark, folder, "lineitem"))


def as_adc_samples(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        (F.col("l_suppkey") % 10).alias("device_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_ms"),
        (1200 + (F.col("l_partkey") * 37 + F.col("l_linenumber") * 101) % 1709).cast("int").alias("raw_v"),
        (
            2000
            + (F.col("l_partkey") * 13 + F.col("l_linenumber") * 7)
            % F.when(F.col("l_suppkey") % 10 == 0, 50).otherwise(300)
        )
        .cast("int")
        .alias("raw_i"),
    )
