"""Settings of each device, as they hold at each reading."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, Settings
from gridlens.functions import scalar
from gridlens.operators import anomaly, energy, insights, records, settings
from gridlens.plans import reports
from gridlens.sources import parse

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    """Device 1 changes its settings twice at once in its third second, 2 has some from the start, 3 one unreadable field, 4 none."""
    rows = [
        (1, START + dt.timedelta(seconds=3), "10", "240", "200", "15", "500", "€"),
        (1, START + dt.timedelta(seconds=3), "10", "240", "200", "15", "400", "€"),
        (1, START + dt.timedelta(seconds=90), "50", "100", "50", "1", "100", "€"),
        (2, None, "2", "250", "200", "15", "3000", "$$$$"),
        (3, None, "x", "nan", None, "15", "3000", ""),
    ]
    names = "cost_per_kwh string, voltage_high string, voltage_low string, current_max string, power_max string, currency string"
    return parse.settings_table(spark.createDataFrame(rows, f"device_id long, valid_from timestamp_ntz, {names}"))


@pytest.fixture(scope="module")
def df(series):
    return series({d: [(245.0, 2.0, 450.0)] * 6 for d in (1, 2, 3, 4)})


def test_versions_hold_from_their_time(df, table):
    found = settings.as_of(df, table).select("device_id", "seq", "settings.*").collect()
    limits = {(r["device_id"], r["seq"]): (r["cost_per_kwh"], r["power_max"], r["currency"]) for r in found}
    assert len(found) == 24
    assert [limits[1, n] for n in range(6)] == [(6.5, 3000.0, "₹")] * 3 + [(10.0, 500.0, "€")] * 3
    assert limits[2, 0] == (2.0, 3000.0, "$$$") and limits[3, 0] == limits[4, 0] == (6.5, 3000.0, "₹")


def test_no_settings_are_the_defaults(spark, df, table):
    for by in (table.limit(0), table.where("device_id = 4")):
        assert records.threshold_alerts(df, by).count() == records.threshold_alerts(df).count() == 0
        assert energy.energy_audit(df, by).exceptAll(energy.energy_audit(df)).isEmpty()
        assert insights.insights(df.withColumns({"anomaly_score": F.lit(0.1), "fault_id": F.lit(0)}), by).exceptAll(
            insights.insights(df.withColumns({"anomaly_score": F.lit(0.1), "fault_id": F.lit(0)}))
        ).isEmpty()
    assert settings.as_of(df.limit(0), table).count() == 0


def test_alerts_and_statuses_follow_the_limits(df, table):
    raised = {(r["device_id"], r["seq"]): r["message"] for r in records.threshold_alerts(df, table).collect()}
    assert sorted(raised) == [(1, 3), (1, 4), (1, 5)] and raised[1, 3] == "⚡ OVERVOLTAGE: 245.0V (limit: 240.0V)"
    rows, s = settings.resolved(df, table)
    status = {(r["device_id"], r["seq"]): r["x"] for r in rows.select("device_id", "seq", scalar.load_status4(s=s).alias("x")).collect()}
    assert status[1, 2] == "LIGHT" and status[1, 3] == "HIGH LOAD" and status[2, 5] == "LIGHT"
    log = {(r["device_id"], r["seq"]): r["status"] for r in records.reading_log(df.withColumn("energy_kwh", F.lit(0.0)), 20, table).collect()}
    assert log[1, 2] == "normal" and log[1, 4] == "warning"
    scores = {(r["device_id"], r["seq"]): r["threshold"] for r in anomaly.detect(df, anomaly.train_stats(df), settings=table).collect()}
    assert scores[1, 2] == 0 and scores[1, 3] == pytest.approx(5 / 24 * 0.4) and scores[4, 5] == 0
    assert {r["status"] for r in reports.daily_report(df, table).where("device_id = 1").collect()} == {"Normal", "High"}


def test_energy_costs_the_rate_of_its_time(df, table):
    """Five seconds at 450 W: two at the old rate, three at the new one."""
    second = 0.45 / 3600
    spent = {r["device_id"]: r["spent"] for r in energy.energy_totals(df, table).collect()}
    assert spent[1] == pytest.approx(second * (2 * 6.5 + 3 * 10)) and spent[2] == pytest.approx(second * 5 * 2) and spent[4] == pytest.approx(second * 5 * 6.5)
    long = df.withColumn("ts", (F.lit(START).cast("timestamp_ntz") + F.make_interval(hours="seq")))
    changed = table.withColumn("valid_from", F.when(F.col("device_id") == 1, F.lit(START + dt.timedelta(hours=3)).cast("timestamp_ntz")))
    changed = changed.where("device_id <> 1 OR power_max = 500")
    total = {(r["device_id"], r["period"]): r["cost"] for r in energy.energy_audit(long, changed).collect()}
    assert total[1, "total"] == total[1, "today"] == round(0.45 * 43, 2) and total[2, "total"] == 4.5
    assert {r["device_id"]: r["cost"] for r in energy.energy_report(long, changed).collect()}[1] == round(0.45 * 43, 2)
    assert {r["device_id"]: r["cost"] for r in reports.report_summary(long, changed).collect()}[1] == round(0.45 * 43, 2)
    assert {r["device_id"]: r["cost"] for r in reports.monthly_report(long, changed).collect()}[2] == 4.5


def test_device_figures_take_the_newest_settings(series, table):
    df = series({d: [(245.0, 2.0, 450.0)] * 80 for d in (1, 2)}).withColumns({"anomaly_score": F.lit(0.1), "fault_id": F.lit(0)})
    report = {r["device_id"]: r for r in insights.efficiency_report(df, table).collect()}
    assert report[1]["load_utilization_pct"] == 90.0 and report[1]["currency"] == "€" and report[2]["load_utilization_pct"] == 15.0
    found = {(r["device_id"], r["title"]): r["description"] for r in insights.insights(df, table).collect()}
    assert (1, "High Voltage Detected") in found and (1, "High Power Usage") in found and (2, "Voltage Stable") in found
    assert "€" in found[1, "Energy Cost Analysis"] and "$$$" in found[2, "Energy Cost Analysis"]
    titles = {(r["device_id"], r["title"]) for r in insights.recommendations(df, table).collect()}
    assert {(1, "Install Voltage Stabilizer"), (1, "Reduce Peak Load")} <= titles and not {(2, "Install Voltage Stabilizer"), (2, "Reduce Peak Load")} & titles


def test_one_set_for_all_still_works(df):
    rows, s = settings.resolved(df, Settings(voltage_high=240.0))
    assert rows is df and records.threshold_alerts(df, s).count() == 24 and records.threshold_alerts(df, DEFAULTS).count() == 0
