"""Streams over several files equal the batch operators over all of them."""

import pytest
from conftest import SMALL, frame
from pandas.testing import assert_frame_equal
from pyspark.sql import functions as F

from gridlens.functions import scalar
from gridlens.operators import energy, features, records
from gridlens.sources import adc, parse, tables
from gridlens.streaming import jobs, state


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The readings as four files in order of time."""
    path = str(tmp_path_factory.mktemp("readings"))
    rows = tables.readings_coarse(spark, SMALL)
    for part in range(4):
        rows.filter((F.col("seq") >= part * 250) & (F.col("seq") < (part + 1) * 250)).coalesce(1).write.mode("append").parquet(path)
    return path


def streamed(spark, folder):
    return jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, maxFilesPerTrigger="1")


def batch(spark, folder):
    return spark.read.parquet(folder)


@pytest.fixture(autouse=True)
def one_file_per_trigger(monkeypatch):
    # The byte limit and a file limit exclude each other.
    def read(spark, path, schema, fmt="parquet", **options):
        return spark.readStream.format(fmt).schema(schema).options(**options).load(path)

    monkeypatch.setattr(jobs, "read_stream", read)


def test_running_stats(spark, folder):
    found = jobs.run_to_table(state.running_stats(streamed(spark, folder)))
    expected = energy.running_energy(batch(spark, folder))
    assert_frame_equal(frame(found.select(*expected.columns), "seq"), frame(expected, "seq"), rtol=1e-9)
    last = records.latest_reading(found, order=("pos",))
    stats = energy.signal_stats(batch(spark, folder)).withColumnRenamed("samples", "pos")
    assert_frame_equal(frame(last.select(*stats.columns)), frame(stats), rtol=1e-9)
    peaks = energy.peaks(batch(spark, folder)).select("device_id", "peak_power", F.unix_micros(F.col("peak_power_time").cast("timestamp")).alias("peak_power_us"))
    assert_frame_equal(frame(last.select(*peaks.columns)), frame(peaks))


def test_window_features(spark, folder):
    found = jobs.run_to_table(state.window_features(streamed(spark, folder)))
    expected = features.sliding_features(batch(spark, folder)).drop("pos")
    assert len(frame(expected)) > 500
    assert_frame_equal(frame(found, "seq"), frame(expected, "seq"), rtol=1e-9, atol=1e-9)


def test_ewma(spark, folder):
    found = jobs.run_to_table(state.ewma(streamed(spark, folder)))
    expected = adc.ewma_snap(batch(spark, folder)).drop("pos")
    assert_frame_equal(frame(found, "seq"), frame(expected, "seq"), rtol=1e-12)


def test_drop_repeated(spark, folder):
    def hourly(df):
        return df.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))

    found = jobs.run_to_table(state.drop_repeated(hourly(streamed(spark, folder))))
    assert_frame_equal(frame(found, "seq"), frame(parse.drop_repeated(hourly(batch(spark, folder))), "seq"))


ORDERS = {"by device": "device_id % 4", "reverse time": "3 - div(seq, 250)", "mixed": "seq % 4"}


def dealt(spark, rows, path, order):
    """Four files, one for each micro-batch, read in the order they are written."""
    for part in range(4):
        rows.filter(F.expr(order) == part).coalesce(1).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, rows.schema, maxFilesPerTrigger="1")


@pytest.mark.parametrize("order", ORDERS)
def test_adc_windows(spark, tmp_path, order):
    samples = tables.adc_samples(spark, SMALL)
    by = {"by device": "device_id % 4", "reverse time": "3 - least(div(sample_ms, 15000), 3)", "mixed": "sample_ms % 4"}[order]
    found = jobs.adc_stream(dealt(spark, samples, f"{tmp_path}/in", by), 1000, f"{tmp_path}/out")
    expected = adc.adc_to_rms(samples, 1000)
    assert found.agg(F.sum("samples")).first()[0] == samples.count()
    assert_frame_equal(frame(found, "device_id", "window_start_ms"), frame(expected, "device_id", "window_start_ms"))


@pytest.mark.parametrize("order", ORDERS)
def test_sessions(spark, tmp_path, order):
    rows = tables.readings_coarse(spark, SMALL).withColumn("device_id", F.col("device_id") % 8)
    found = jobs.session_stream(dealt(spark, rows, f"{tmp_path}/in", ORDERS[order]), 1000, f"{tmp_path}/out")
    expected = energy.session_summary(rows, 1000)
    assert expected.count() > 16 and expected.filter("sample_count > 1").count() > 8
    assert_frame_equal(frame(found, "device_id", "session_no"), frame(expected.select(found.columns), "device_id", "session_no"))


def test_tables(spark, folder, tmp_path):
    """Four micro-batches, compacted each second one; a repeated micro-batch changes nothing."""
    def scored(df):
        return tables.predictions(df).withColumn("is_anomaly", scalar.is_anomaly("anomaly_score"))

    kept = jobs.Tables(spark, f"{tmp_path}/tables", compact_every=2, keep=12, perf_log=tables.inference_log(spark, SMALL))
    kept.start(scored(state.running_stats(streamed(spark, folder))), f"{tmp_path}/checkpoint").awaitTermination()
    metered = scored(energy.running_energy(batch(spark, folder)))
    nth = records.every_nth(metered, 5)

    def check():
        live = kept.read("live").select("device_id", "seq")
        assert_frame_equal(frame(live), frame(records.latest_reading(metered).select("device_id", "seq")))
        history = kept.read("readings").select("device_id", "seq")
        assert_frame_equal(frame(history), frame(records.retain_last(nth, 12).select("device_id", "seq")))
        alerts = kept.read("alerts")
        assert_frame_equal(frame(alerts, "seq"), frame(records.alert_record(metered).select(*alerts.columns), "seq"))
        session = kept.read("session")
        assert session.agg(F.sum("sample_count")).first()[0] == 1000
        assert kept.read("perf").count() == 10

    check()
    folders = {f"{n}{b}": sorted(f.name for f in (tmp_path / "tables" / f"{n}{b}").iterdir() if "=" in f.name) for n in ("readings", "history") for b in ("", "_base")}
    assert folders["readings"] == folders["history"] == ["batch_id=2", "batch_id=3"] and folders["history_base"] == ["upto=1", "upto=3"]
    raw = scored(jobs.run_to_table(state.running_stats(streamed(spark, folder))))
    last = raw.filter("seq >= 750")
    kept.store(last, 3)
    check()
    health = kept.read("health").orderBy("device_id").collect()
    counts = {r["device_id"]: r["n"] for r in metered.groupBy("device_id").agg(F.count("*").alias("n")).collect()}
    assert {r["device_id"]: r["pos"] for r in health} == {d: n // 10 * 10 for d, n in counts.items()}
    assert kept.read("recommendations").count() > 0
    kept.expire("readings", 3)
    check()


def test_late_rows_add_no_energy(spark, series):
    import pandas as pd

    rows = pd.DataFrame({"device_id": 1, "seq": [1], "ts": [pd.Timestamp("2024-01-01 00:00:10")], "voltage": 230.0, "current": 1.0, "power": 3600.0})
    _, held = state._stats_step(rows, None)
    late, held = state._stats_step(rows.assign(ts=pd.Timestamp("2024-01-01 00:00:05")), held)
    assert late["energy_kwh"].iloc[0] == 0
    after, _ = state._stats_step(rows.assign(ts=pd.Timestamp("2024-01-01 00:00:11")), held)
    assert after["energy_kwh"].iloc[0] == pytest.approx(0.001) and after["pos"].iloc[0] == 3
