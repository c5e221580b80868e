from __future__ import annotations

import datetime as dt
import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle  # noqa: E402

import gridlens  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return gridlens.tune(oracle.session())


@pytest.fixture(scope="session")
def small(spark):
    """Readings of ten devices, about a hundred each."""
    from gridlens.session import materialize
    from gridlens.sources import tables

    return materialize(tables.predictions(tables.readings_coarse(spark, SMALL)), "small")


@pytest.fixture(scope="session")
def series(spark):
    """Builds readings of devices from lists of (voltage, current, power), one second apart."""

    def build(devices: dict[int, list[tuple]]):
        rows = []
        for device, values in devices.items():
            for n, (v, i, p) in enumerate(values):
                at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
                rows.append((device, n, at, float(v), float(i), float(p)))
        schema = "device_id long, seq long, ts timestamp_ntz, voltage double, current double, power double"
        return spark.createDataFrame(rows, schema)

    return build


def frame(df, *order) -> pd.DataFrame:
    """Rows in a fixed order, with columns by name."""
    rows = df.toPandas()
    rows = rows[sorted(rows.columns)]
    return rows.sort_values(list(order) or list(rows.columns), ignore_index=True)
