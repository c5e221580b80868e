"""Numbers of rows: places in a total order, without sorting a group in one task, and numbers that every scan gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import materialize


def placed(df: DataFrame, order: Sequence[str], within: str, name: str) -> DataFrame:
    """Add ``place``, from 0 in the order of ``order`` inside each group ``within`` (never null), and ``n``, the group's rows.

    Rows are dealt out by ranges of (group, order), so a large group is spread over many tasks. What was laid out
    is written once, hence its row numbers are fixed; places follow from the rows of each group per range.
    """
    laid = df.repartitionByRange(within, *order).sortWithinPartitions(within, *order)
    laid = materialize(laid.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_range", F.shiftright("_at", 33))
    runs = laid.groupBy(within, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(within)
    before = F.sum("_rows").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(within, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("n"))
    return laid.join(starts, [within, "_range"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


class Numbered:
    """Rows of a table with a number that is the same in every scan of it, whatever executors there are.

    The number is made of the row's file and its place in that file. How files are cut into tasks, which depends on the cores at hand,
    has no part in it. A table that is not read from Parquet files is written first.
    """

    def __init__(self, df: DataFrame):
        try:
            df.select(df.metadataColumn("_metadata")["row_index"])
        except AnalysisException:
            df = materialize(df, "numbered")
        self.df = df
        path = F.xxhash64(df.metadataColumn("_metadata")["file_path"])
        paths = df.select(path.alias("_file"), df.metadataColumn("_metadata")["file_path"].alias("_path")).distinct()
        order = F.row_number().over(Window.orderBy("_path"))
        self.files = materialize(paths.withColumn("_no", order.cast("long")).drop("_path"), "file-numbers")
        self.path = path

    def select(self, **columns: Column) -> DataFrame:
        """``row`` and the given columns of every row."""
        at = self.df.metadataColumn("_metadata")["row_index"]
        rows = self.df.select(self.path.alias("_file"), at.alias("_at"), *[c.alias(n) for n, c in columns.items()])
        # Two numbers per file, of which the driver holds the names anyhow.
        placed = rows.join(F.broadcast(self.files), "_file")
        return placed.select((F.shiftleft("_no", 40) + F.col("_at")).alias("row"), *columns)
