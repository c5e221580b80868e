"""Window features against a plain recomputation per window."""

import numpy as np
import pytest

from gridlens.config import DEFAULTS
from gridlens.operators import features


def plain(v, i, p):
    """Features of one window, written out with scalar formulas."""
    f = {}
    for name, x in (("voltage", v), ("current", i), ("power", p)):
        m, sd = x.mean(), x.std() if np.ptp(x) > 0 else 0.0
        f[f"{name}_mean"], f[f"{name}_std"], f[f"{name}_rms"] = m, sd, np.sqrt((x**2).mean())
        f[f"{name}_min"], f[f"{name}_max"], f[f"{name}_range"] = x.min(), x.max(), np.ptp(x)
        f[f"{name}_skew"] = ((x - m) ** 3).mean() / sd**3 if sd > 0 else 0
        f[f"{name}_kurtosis"] = ((x - m) ** 4).mean() / sd**4 - 3 if sd > 0 else 0
        f[f"{name}_median"] = np.percentile(x, 50)
        f[f"{name}_q25"], f[f"{name}_q75"] = np.percentile(x, [25, 75])
        f[f"{name}_iqr"] = f[f"{name}_q75"] - f[f"{name}_q25"]
        slope, intercept = np.polyfit(np.arange(len(x)), x, 1)
        f[f"{name}_trend_slope"], f[f"{name}_trend_intercept"] = slope, intercept
        half = len(x) // 2
        f[f"{name}_rate_of_change"] = x[-1] - m
        f[f"{name}_acceleration"] = np.diff(x[half:]).mean() - np.diff(x[:half]).mean()
        f[f"{name}_stability_idx"] = 1 - min(sd / m if m > 0 else 0, 1)
    s = v.mean() * i.mean()
    f |= {
        "voltage_deviation_pct": abs(v.mean() - 230) / 230 * 100,
        "voltage_thd_estimate": f["voltage_std"] / v.mean() * 100 if v.mean() > 0 else 0,
        "current_load_pct": i.mean() / 15 * 100,
        "power_load_pct": p.mean() / 3000 * 100,
        "apparent_power": s,
        "power_factor": p.mean() / s if s > 0 else 0,
        "reactive_power": np.sqrt(max(s**2 - p.mean() ** 2, 0)),
        "voltage_crest_factor": v.max() / f["voltage_rms"] if f["voltage_rms"] > 0 else 1,
        "current_crest_factor": i.max() / f["current_rms"] if f["current_rms"] > 0 else 1,
        "energy_rate_wh_per_min": p.mean() / 60,
        "power_voltage_ratio": p.mean() / v.mean() if v.mean() > 0 else 0,
        "power_current_ratio": p.mean() / i.mean() if i.mean() > 0 else 0,
        "is_voltage_in_range": float(200 <= v.mean() <= 250),
        "is_current_safe": float(i.mean() <= 15),
        "is_power_safe": float(p.mean() <= 3000),
    }
    for name, a, b in (("vi", v, i), ("vp", v, p), ("ip", i, p)):
        f[f"{name}_correlation"] = np.corrcoef(a, b)[0, 1] if np.ptp(a) > 0 and np.ptp(b) > 0 else 0
    return f


def check(v, i, p):
    found = features.window_matrix(v[None], i[None], p[None], features.FEATURE_NAMES, DEFAULTS)
    expected = plain(v, i, p)
    assert set(found) == set(expected) and len(found) == 69
    for name, value in expected.items():
        assert found[name][0] == pytest.approx(value, rel=1e-7, abs=1e-7), name


@pytest.mark.parametrize("seed", range(10))
def test_random_windows(seed):
    rng = np.random.default_rng(seed)
    v, i = rng.normal(230, 15, 30), np.abs(rng.normal(6, 4, 30))
    check(v, i, v * i * rng.uniform(0.5, 1, 30))


def test_steady_window():
    check(np.full(30, 230.1), np.full(30, 2.3), np.full(30, 486.9))


def test_idle_window():
    check(np.full(30, 230.0), np.zeros(30), np.zeros(30))


def test_dead_window():
    check(np.zeros(30), np.zeros(30), np.zeros(30))


def test_windows_do_not_cross_devices(series):
    df = series({1: [(230, 1, 200)] * 29, 2: [(240, 2, 400)] * 31})
    found = features.sliding_features(df).select("device_id", "seq", "voltage_mean", "pos").orderBy("seq").collect()
    assert [tuple(r) for r in found] == [(2, 29, 240.0, 30), (2, 30, 240.0, 31)]


def test_small_batches_carry_their_tail(spark, small):
    wide = features.sliding_features(small, names=["power_mean"]).orderBy("device_id", "seq").toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        narrow = features.sliding_features(small, names=["power_mean"]).orderBy("device_id", "seq").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(wide) > 500 and wide.equals(narrow)


def test_tumbling_label_is_the_smallest_most_common(series, spark):
    from pyspark.sql import functions as F

    df = series({1: [(230, 1, 200)] * 65}).withColumn("fault_label", F.when(F.col("seq") % 2 == 0, 4).otherwise(1))
    rows = features.tumbling_features(df).select("window_no", "fault_label").orderBy("window_no").collect()
    assert [tuple(r) for r in rows] == [(0, 1), (1, 1)]
