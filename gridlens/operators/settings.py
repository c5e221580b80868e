"""Settings of each device, with the time from which they hold.

Operators take ``settings`` as one ``Settings`` for the whole fleet or as a table of validated settings (``parse.settings_table``): a row per device and
change, with ``valid_from``, null where they hold from the start. Limits and rates are then those in force at each reading,
and for figures of a whole device those at its newest reading. Devices without settings, and readings before the first of them, have the defaults.

The versions of a device are gathered into one row, so that joining them adds no rows, and adaptive execution can split a
busy device's readings against it. Of versions with the same time the largest values hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, KEYS, SETTING_RANGES, Settings

NAMES = (*SETTING_RANGES, "currency")


def per_row(base: Settings = DEFAULTS) -> Settings:
    """Settings whose limits and rates are those in the column ``settings`` of each row."""
    return replace(base, **{n: F.col(f"settings.{n}") for n in NAMES})


def versions(table: DataFrame, keys: Sequence[str] = KEYS, base: Settings = DEFAULTS) -> DataFrame:
    """All versions of each device in order, as one row."""
    values = F.struct(*[F.coalesce(F.col(n), F.lit(getattr(base, n))).alias(n) for n in NAMES])
    since = F.col("valid_from") if "valid_from" in table.columns else F.lit(None).cast("timestamp_ntz")
    return table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(since.alias("since"), values.alias("values")))).alias("_versions"))


def as_of(df: DataFrame, table: DataFrame, at: str = "ts", keys: Sequence[str] = KEYS, base: Settings = DEFAULTS) -> DataFrame:
    """Add ``settings``, those of the device in force at the time ``at`` of each row."""
    default = F.struct(*[F.lit(getattr(base, n)).alias(n) for n in NAMES])
    begun = F.filter("_versions", lambda v: v["since"].isNull() | (v["since"] <= F.col(at)))
    joined = df.join(versions(table, keys, base), list(keys), "left")
    return joined.withColumn("settings", F.coalesce(F.try_element_at(begun, F.lit(-1))["values"], default)).drop("_versions")


def resolved(df: DataFrame, settings: Settings | DataFrame, keys: Sequence[str] = KEYS, at: str = "ts") -> tuple[DataFrame, Settings]:
    """Rows and the settings to compute with: for a table, those of each row at the time ``at``."""
    if isinstance(settings, Settings):
        return df, settings
    return as_of(df, settings, at, keys), per_row()


def text(value: str | float | Column) -> Column:
    """A setting as it is written in texts."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")
