"""Reading logs and labelled datasets as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from gridlens.functions.numeric import fixed

LOG_SCHEMA = "timestamp TIMESTAMP, voltage DOUBLE, current DOUBLE, power DOUBLE"
DATASET_SCHEMA = LOG_SCHEMA + ", fault_label INT, fault_name STRING"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def append_log(df: DataFrame, path: str) -> None:
    """Append readings to a CSV log, to the second and with fixed decimals."""
    rows = df.select(
        F.date_format("ts", TIME_FORMAT).alias("timestamp"),
        fixed("voltage", 2).alias("voltage"),
        fixed("current", 3).alias("current"),
        fixed("power", 2).alias("power"),
    )
    rows.write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("header", True).option("timestampFormat", TIME_FORMAT).csv(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Save labelled readings, one file set per call."""
    rows = df.select(
        F.col("ts").cast("timestamp").alias("timestamp"), "voltage", "current", "power", "fault_label", "fault_name"
    )
    rows.write.mode("overwrite").option("header", True).format(fmt).save(path)


def read_dataset(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame | None:
    """Labelled readings, or nothing where none were saved."""
    try:
        return spark.read.schema(DATASET_SCHEMA).option("header", True).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
