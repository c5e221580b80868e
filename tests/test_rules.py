"""Rules at their boundaries, gates and unusual input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.functions import numeric, scalar
from gridlens.operators import anomaly, energy, faults, features, forecast, insights, records, serving
from gridlens.plans import reports
from gridlens.sources import adc, files, parse


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "v,i,p,score",
    [(230, 5, 1000, 0), (250, 15, 3000, 0), (262.5, 5, 1000, 0.2), (275, 5, 1000, 0.4), (300, 5, 1000, 0.4), (190, 5, 1000, 0.2),
     (180, 5, 1000, 0.4), (230, 16.5, 1000, 0.15), (230, 18, 1000, 0.3), (230, 5, 3300, 0.15), (300, 30, 9000, 1.0)],
)
def test_threshold_score(spark, v, i, p, score):
    assert one(spark, scalar.threshold_score(), voltage=float(v), current=float(i), power=float(p)) == pytest.approx(score)


@pytest.mark.parametrize("p,status", [(3000.1, "OVERLOAD!"), (3000, "HIGH LOAD"), (2100, "NORMAL"), (900.5, "NORMAL"), (900, "LIGHT")])
def test_load_status(spark, p, status):
    assert one(spark, scalar.load_status4(), power=float(p)) == status


@pytest.mark.parametrize("score,label", [(90, "Excellent"), (89.9, "Good"), (75, "Good"), (60, "Fair"), (40, "Poor"), (39.9, "Critical")])
def test_health_label(spark, score, label):
    assert one(spark, scalar.health_label("s"), s=float(score)) == label


def components(spark, **changed):
    facts = dict(n=100, v_mean=230.0, v_std=0.0, i_mean=5.0, i_max=5.0, p_mean=1000.0, p_std=0.0, p_min=1.0, p_max=1.0, p_slope=0.0,
                 scores=100, anomalous=0.0) | changed
    df = spark.createDataFrame([tuple(facts.values())], list(facts))
    return df.select(*[c.alias(n) for n, c in insights.health_components().items()]).first().asDict()


@pytest.mark.parametrize("use,score", [(0.7, 100), (0.85, 70), (1.0, 10), (1.05, 5), (1.2, 0)])
def test_current_safety(spark, use, score):
    assert components(spark, i_max=15 * use)["current_safety"] == pytest.approx(score, abs=1e-6)


def test_efficiency_drops_at_80_percent(spark):
    assert components(spark, p_mean=2399.999)["power_efficiency"] == pytest.approx(76, abs=1e-3)
    assert components(spark, p_mean=2400.0)["power_efficiency"] == pytest.approx(36)


@pytest.mark.parametrize("pf,score", [(0.95, 100), (0.85, 80), (0.7, 40), (0.5, 28.5), (0.0, 0)])
def test_power_factor_score(spark, pf, score):
    assert components(spark, v_mean=200.0, i_mean=5.0, p_mean=1000 * pf + 1e-9)["power_factor"] == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("slope,score", [(0.99, 90), (-0.99, 90), (-1.0, 95), (1.0, 75), (16.0, 0), (20.0, 0)])
def test_energy_trend_score(spark, slope, score):
    assert components(spark, p_slope=slope)["energy_trend"] == score


def test_unknown_components(spark):
    found = components(spark, n=10, scores=10)
    assert found == {"voltage_stability": 50, "current_safety": 50, "power_efficiency": 50, "anomaly_rate": 80, "power_factor": 50,
                     "energy_trend": 70}


def test_anomaly_component(spark):
    assert components(spark, anomalous=0.2)["anomaly_rate"] == 60
    assert components(spark, anomalous=0.9)["anomaly_rate"] == 0


def test_gates(series):
    df = series({n: [(230, 2, 423)] * n for n in (9, 10, 21, 29, 30, 59, 60, 61)}).withColumns(
        {"anomaly_score": F.lit(0.1), "fault_id": F.lit(0), "confidence": F.lit(1.0)}
    )
    found = insights.insights(df).groupBy("device_id").agg(F.collect_set("title").alias("t")).collect()
    titles = {r["device_id"]: set(r["t"]) for r in found}
    assert titles[9] == {"Collecting Data"}
    assert titles[10] == {"Energy Cost Analysis"}
    assert {"Voltage Stable", "Normal Power Usage"} <= titles[21]
    advice = {r["device_id"]: r["title"] for r in insights.recommendations(df).collect()}
    assert advice[29] == "Gathering Data" and advice.get(30) is None
    status = {r["device_id"]: r["status"] for r in insights.efficiency_report(df).collect()}
    assert status[59] == "insufficient_data" and status[60] == "ready"
    health = {r["device_id"]: r for r in insights.health_score(insights.device_summary(df)).collect()}
    assert health[10]["energy_trend"] == 70 and health[61]["energy_trend"] == 90
    # 25 + 20 + 95.77 * 0.2 + 15 + (80 + 0.0696 * 200) * 0.1 + 9
    assert health[61]["overall_score"] == 97.5 and health[61]["label"] == "Excellent"
    shaped = insights.health_struct(insights.health_score(insights.device_summary(df))).first()
    assert shaped["components"].keys() == shaped["weights"].keys()


def test_recommendations_are_ordered(series):
    noisy = [(260 if n % 2 else 245, 12, 5000 if n % 2 else 300) for n in range(80)]
    found = insights.recommendations(series({1: noisy})).orderBy("position").collect()
    assert [r["priority"] for r in found] == ["high", "high", "medium", "low"]
    assert [r["title"] for r in found] == [
        "Install Voltage Stabilizer", "Reduce Peak Load", "Stabilize Load Profile", "Energy Saving Tips"]


def test_idle_device_power_factor(series):
    df = series({1: [(230, 0, 0)] * 70})
    report = insights.efficiency_report(df).first()
    assert report["power_factor"] == 0 and report["avg_power_w"] == 0 and report["total_energy_kwh"] == 0
    assert insights.recommendations(df).count() == 0  # nothing to correct without a load
    assert energy.peaks(df).first()["peak_power_time"] is None


def test_first_peak_wins(series):
    df = series({1: [(230, 1, 50), (231, 3, 80), (231, 3, 80), (229, 2, 70)]})
    row = energy.peaks(df).first()
    assert row["peak_power"] == 80 and row["peak_power_time"] == dt.datetime(2024, 1, 1, 0, 0, 1)


def test_energy_uses_the_reading_at_the_end_of_each_step(series):
    df = series({1: [(230, 1, 3600), (230, 1, 7200), (230, 1, 3600)]})
    assert energy.energy_totals(df).first()["energy_kwh"] == pytest.approx((7.2 + 3.6) / 3600)


def test_lines(spark):
    lines = ["230.5,2.5", " 230.5 , 2.5,9", "230", "a,1", "1,", "", "nan,1", "inf,2", "230,1e1"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r["current"] for r in parse.parse_lines(df).collect()] == [2.5, 2.5, 1.0, 2.0, 10.0]
    strict = parse.parse_lines(df, strict=True).collect()
    assert [round(r["power"], 4) for r in strict] == [530.15, 530.15, 2116.0]


def test_tagged_and_json(spark):
    df = spark.createDataFrame([("Vrms: 231.5 V Current: 2.1 A Power: 440.0",), ("Vrms: ",), ("Vrms: 1.2.3 Current: 1 Power: 1",)], "value string")
    assert parse.parse_tagged_lines(df).collect()[0].asDict() == {"voltage": 231.5, "current": 2.1, "power": 440.0}
    df = spark.createDataFrame([('{"voltage": 1, "current": 2, "power": 3, "x": 4}',), ("[]",), ('{"voltage": 1}',), ("{",)], "value string")
    assert [tuple(r) for r in parse.parse_json_payload(df).collect()] == [(1.0, 2.0, 3.0)]


@pytest.mark.parametrize("text,number", [("12.5", 12.5), ("nan", 7), ("inf", 7), ("-inf", 7), ("x", 7), (None, 7), ("-3", 0), ("900", 500)])
def test_sanitize(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(numeric.sanitize("t", 7.0, 0.0, 500.0).alias("x")).first()[0] == number


def test_repeats_are_consecutive_only(spark):
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (0, 0, 1, 0, 0, 0, 2)]
    df = spark.createDataFrame([(1, n, t) for n, t in enumerate(at)], "device_id int, seq int, ts timestamp_ntz")
    assert [r["seq"] for r in parse.drop_repeated(df).orderBy("seq").collect()] == [0, 2, 3, 6]


@pytest.mark.parametrize("rf,gb,fault,conf", [
    ([0.6, 0.4], [0.2, 0.8], 1, 0.58), ([0.6, 0.4], None, 0, 0.6), (None, [0.2, 0.8], 1, 0.8), (None, None, 0, 1.0),
    ([0.5, 0.5, 0.9], [0.5, 0.5], 0, 0.5)])
def test_votes(spark, rf, gb, fault, conf):
    df = spark.createDataFrame([(rf, gb)], "rf array<double>, gb array<double>").withColumn("p", scalar.soft_vote("rf", "gb"))
    row = df.select(scalar.predicted_class("p").alias("f"), scalar.predicted_confidence("p").alias("c")).first()
    assert row["f"] == fault and row["c"] == pytest.approx(conf)


def test_top_classes(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.1, 0.4],)], "p array<double>")
    top = df.select(scalar.top_classes("p").alias("t")).first()["t"]
    assert [(t["id"], t["name"]) for t in top] == [(3, "Overcurrent"), (1, "Overvoltage"), (2, "Undervoltage")]


def test_signals_that_never_vary_have_no_zscore(series):
    df = series({1: [(230, 1, 100), (230, 2, 100), (230, 3, 100)]})
    scores = anomaly.with_zscore(df, anomaly.train_stats(df)).orderBy("seq").collect()
    assert [r["zscore"] for r in scores] == pytest.approx([1.5**0.5 / 4, 0, 1.5**0.5 / 4])
    flat = series({1: [(230, 1, 100)] * 3})
    assert anomaly.with_zscore(flat, anomaly.train_stats(flat)).first()["zscore"] == 0


def test_zscore_over_all_devices_and_for_unknown_ones(series):
    df = series({1: [(230, 1, 100), (230, 3, 100)], 2: [(230, 2, 100)] * 2})
    whole = anomaly.train_stats(df, ())
    assert {round(r["zscore"], 3) for r in anomaly.with_zscore(df, whole, ()).collect()} == {0.0, 0.354}
    assert anomaly.zscore_alerts(df, whole, ()).count() == 0
    found = anomaly.with_zscore(df, anomaly.train_stats(df.filter("device_id = 1"))).filter("device_id = 2").collect()
    assert [r["zscore"] for r in found] == [0, 0]
    assert anomaly.detect(df, whole, stat_keys=()).count() == 4


def test_moving_average_needs_ten(series):
    df = series({1: [(230, 2, 400)] * 9 + [(230, 4, 400)] * 2})
    found = [r["moving_avg"] for r in features.moving_average_scores(df).orderBy("seq").collect()]
    assert found[:9] == [0] * 9 and found[9] == pytest.approx(1 / 3) and found[10] > 0


def test_forecast_without_data(series):
    df = series({1: [(230, 1, 100)] * 2, 2: [(230, 1, 10 * n) for n in range(20)], 3: [(230, 1, 2000 - 100 * n) for n in range(20)]})
    found = forecast.forecast(df, *forecast.fit_trend(df)).collect()
    by = {(r["device_id"], r["step"]): r for r in found}
    assert by[1, 1]["forecast"] == 0 and by[1, 1]["upper"] == 0
    assert by[2, 1]["forecast"] == pytest.approx(200) and by[2, 15]["forecast"] == pytest.approx(340)
    assert by[3, 15]["forecast"] == 0 and by[3, 15]["lower"] == 0 and by[3, 15]["upper"] > 0
    directions = {r["device_id"]: r["direction"] for r in forecast.trend(df).collect()}
    assert directions == {1: "unknown", 2: "increasing", 3: "decreasing"}


def test_forecast_without_a_fit(series):
    df = series({1: [(230, 1, 100)] * 5 + [(230, 1, 300)] * 10})
    fits, seasons = forecast.fit_trend(df)
    found = forecast.forecast(df, fits.filter("false"), seasons).collect()
    assert {r["forecast"] for r in found} == {300.0}
    longer = forecast.extend_forecast(forecast.forecast(df, fits, seasons), fits.filter("false"), 20).collect()
    assert len(longer) == 20 and len({r["forecast"] for r in longer if r["step"] >= 15}) == 1


def test_scaling_a_signal_that_never_varies(series):
    df = series({1: [(230, 1, 100), (230, 2, 300)]})
    rows = forecast.minmax_scale(df, forecast.signal_ranges(df)).orderBy("seq").collect()
    assert [(r["voltage_scaled"], r["power_scaled"]) for r in rows] == [(0, 0), (0, 1)]


def test_stratified_split_takes_the_share(small):
    rows = faults.stratified_split(small, 0.25).groupBy("fault_label").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    assert all(r["t"] == int(r["n"] * 0.25 + 0.5) for r in rows) and sum(r["n"] for r in rows) == small.count()


def test_few_calls_have_their_maximum(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, n, at + dt.timedelta(seconds=n), m, float(n), 0) for m, c in (("a", 19), ("b", 20)) for n in range(c)],
                               "device_id int, seq int, ts timestamp_ntz, model string, latency_ms double, is_error int")
    found = {r["model"]: r["p95_ms"] for r in serving.latency_by_model(df).collect()}
    assert found == {"a": 18.0, "b": pytest.approx(18.05)}
    times = spark.createDataFrame([("a", 12.5)], "model string, load_time_ms double")
    assert {r["model"]: r["load_time_ms"] for r in serving.latency_by_model(df, load_times=times).collect()} == {"a": 12.5, "b": 0.0}


def test_alerts_join_the_log_once(spark, series):
    df = series({1: [(230, 2, 423)] * 30}).withColumns({"energy_kwh": F.lit(0.0), "is_anomaly": F.col("seq") % 2 == 0,
        "fault_id": F.when(F.col("seq") == 28, 3).otherwise(0), "confidence": F.lit(0.9), "anomaly_score": F.lit(0.5)})
    log, found = records.reading_log(df), records.alert_record(df)
    merged = records.merge_alerts_into_log(log, found).orderBy("position").collect()
    assert len(merged) == 30 and [r["is_alert"] for r in merged] == [True] * 10 + [False] * 20
    assert merged[9]["status"] == "danger" and merged[9]["status_text"] == "fault: Overcurrent (90%)"
    assert merged[0]["status_text"] == "anomaly: Anomaly score=0.500"
    again = log.unionByName(log.filter("seq = 28").withColumn("is_alert", F.lit(True)))
    assert records.merge_alerts_into_log(again, found).filter("status = 'danger'").count() == 0
    assert records.merge_alerts_into_log(log, found, cap=12).count() == 12


def test_reports(spark, small, tmp_path):
    for kind in reports.KINDS:
        reports.write_report(small, kind, str(tmp_path))
        assert spark.read.option("header", True).csv(f"{tmp_path}/{kind}").count() > 0
        assert spark.read.option("header", True).csv(f"{tmp_path}/{kind}_summary").count() == 10
    with pytest.raises(ValueError):
        reports.report(small, "../daily")


def test_log_and_dataset(spark, small, tmp_path):
    files.append_log(small, f"{tmp_path}/log")
    files.append_log(small, f"{tmp_path}/log")
    assert files.read_log(spark, f"{tmp_path}/log").count() == 2 * small.count()
    assert files.read_dataset(spark, f"{tmp_path}/none") is None
    files.write_dataset(small.withColumn("fault_name", scalar.fault_name("fault_label")), f"{tmp_path}/set", "parquet")
    assert files.read_dataset(spark, f"{tmp_path}/set", "parquet").count() == small.count()


def test_smoothing_maps_agree_with_smoothing():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.where(rng.random(rng.integers(1, 40)) < 0.7, 0.0, rng.random(1) * 2)
        pieces = adc.transfer(x, 0.2, 0.5)
        for level in (0.0, 0.3, 0.5, 0.7, 2.0, 40.0):
            assert adc.after(level, pieces) == pytest.approx(adc.smooth(level, x, 0.2, 0.5)[-1], abs=1e-12)


def test_feature_names():
    assert len(features.FEATURE_NAMES) == len(set(features.FEATURE_NAMES)) == 69


def test_unknown_faults(spark):
    df = spark.createDataFrame([(0,), (9,), (10,)], "fault_id int")
    assert [r[0] for r in df.select(scalar.fault_title()).collect()] == ["Normal", "Phase Imbalance", "Unknown Fault (10)"]
    assert [r[0] for r in df.select(scalar.fault_severity()).collect()] == [0, 3, 0]


def test_rounding_goes_up_at_ties(spark):
    assert [one(spark, numeric.half_up("x", 2), x=x) for x in (1.005, 2.675, 0.125, 1.0)] == [1.01, 2.68, 0.13, 1.0]


@pytest.mark.parametrize("seed", range(4))
def test_smoothing_at_once_is_smoothing_each(seed):
    """Long runs, rare and frequent zeros, nothing but zeros, and short inputs, from several levels."""
    from gridlens.sources import adc

    rng = np.random.default_rng(seed)
    cases = [rng.normal(230, 2, 70_000), np.where(rng.random(20_000) < 0.002, 0, 5.3), np.where(rng.random(9_000) < 0.66, 0, rng.random(9_000))]
    cases += [np.where(np.arange(30_000) // 3_000 % 2 == 0, rng.random(30_000) * 5, 0), np.zeros(500), np.ones(1), np.zeros(0), rng.normal(0, 1, 700)]
    for x in cases:
        for level, alpha, snap in ((0.0, 0.2, 0.05), (3.0, 0.2, 5.0), (250.0, 0.7, 0.05)):
            each = adc._smooth_each(level, x, alpha, snap)
            once = adc.smooth(level, x, alpha, snap)
            assert np.allclose(once, each, rtol=0, atol=1e-9) and ((once == 0) == (each == 0)).all()
            cut = len(x) // 3
            pieces = adc.transfer(x[:cut], alpha, snap)
            if (x >= 0).all() and cut:
                assert abs(adc.after(level, pieces) - each[cut - 1]) < 1e-9
