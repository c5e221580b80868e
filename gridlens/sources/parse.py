"""Parsing and cleaning of incoming readings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, FIELD_RANGES, KEYS, SETTING_RANGES, Settings
from gridlens.functions.numeric import col, sanitize
from gridlens.operators.ordered import ordered

PAYLOAD = "voltage DOUBLE, current DOUBLE, power DOUBLE"


def parse_lines(df: DataFrame, value: str = "value", settings: Settings = DEFAULTS, strict: bool = False) -> DataFrame:
    """``voltage,current`` lines to readings with estimated power; other lines are dropped.

    With ``strict``, lines with not-a-number or infinite values are dropped as well.
    """
    parts = F.split(F.col(value), ",", 3)
    v = F.try_element_at(parts, F.lit(1)).try_cast("double")
    i = F.try_element_at(parts, F.lit(2)).try_cast("double")

    def usable(r: Column) -> Column:
        found = r["voltage"].isNotNull() & r["current"].isNotNull()
        if not strict:
            return found
        return found & ~F.isnan(r["voltage"] + r["current"]) & (F.abs(r["voltage"] + r["current"]) != F.lit(float("inf")))

    out = _kept(df, F.struct(v.alias("voltage"), i.alias("current")), usable)
    power = F.col("voltage") * F.col("current") * F.lit(settings.assumed_power_factor)
    return out.withColumn("power", power).drop(value)


def _kept(df: DataFrame, parsed: Column, usable: Callable[[Column], Column]) -> DataFrame:
    """Append the fields of ``parsed`` where it is usable and drop other rows.

    As a generator, the parsed struct is evaluated once; a filter on it would be pushed below the
    projection and parse each line again.
    """
    return df.select("*", F.inline(F.filter(F.array(parsed), usable)))


def _complete(r: Column) -> Column:
    return r["voltage"].isNotNull() & r["current"].isNotNull() & r["power"].isNotNull()


def parse_tagged_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Lines such as ``Vrms: 230.1 V Current: 2.5 A Power: 529.2 W``; other lines are dropped."""
    # fixed value: the accepted form of a line
    pattern = r"Vrms:\s([\d.]+).*Current:\s([\d.]+).*Power:\s([\d.]+)"
    names = ("voltage", "current", "power")
    groups = [F.regexp_extract(value, pattern, n).try_cast("double").alias(c) for n, c in enumerate(names, start=1)]
    return _kept(df, F.struct(*groups), _complete).drop(value)


def parse_json_payload(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages with voltage, current and power; malformed messages are dropped."""
    return _kept(df, F.from_json(value, PAYLOAD), _complete).drop(value)


def sanitize_fields(df: DataFrame, fallbacks: dict[str, float]) -> DataFrame:
    """Force the fields named in ``fallbacks`` into their accepted ranges."""
    return df.withColumns({c: sanitize(c, fb, *FIELD_RANGES[c]) for c, fb in fallbacks.items()})


def drop_test_rows(df: DataFrame, flags: Sequence[str] = ("test_mode",)) -> DataFrame:
    """Drop rows sent while testing."""
    keep: Column = F.lit(True)
    for flag in flags:
        keep = keep & ~F.coalesce(col(flag), F.lit(False))
    return df.filter(keep)


def drop_repeated(
    df: DataFrame,
    ts: str = "ts",
    keys: Sequence[str] = KEYS,
    arrival: Sequence[str] = ("seq",),
    **split,
) -> DataFrame:
    """Drop a reading with the timestamp of the one that arrived just before it."""
    series = ordered(df, keys, arrival, behind=1, **split)
    marked = series.df.withColumn("_previous", F.lag(ts).over(series.window()))
    kept = marked.filter(F.col("_previous").isNull() | (F.col("_previous") != F.col(ts)))
    return series.own(kept).drop("_previous", "pos")


def settings_table(overrides: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Validated settings per device from raw text; unreadable values take the defaults."""
    out = overrides.withColumns(
        {name: sanitize(name, getattr(settings, name), *SETTING_RANGES[name]) for name in SETTING_RANGES}
    )
    text = F.when(F.coalesce(F.col("currency"), F.lit("")) == "", settings.currency).otherwise(F.col("currency"))
    return out.withColumn("currency", F.substring(text, 1, 3))
