"""A device too large for one task is split into chunks; results stay the same."""

import pytest
from conftest import SMALL, frame
from pandas.testing import assert_frame_equal
from pyspark.sql import functions as F

from gridlens.operators import anomaly, energy, faults, features, forecast, ordered, records
from gridlens.plans import reports
from gridlens.session import materialize
from gridlens.sources import adc, parse, tables

SPLIT = {"limit": 20, "chunk": 32}
WIDE = {"limit": 20, "chunk": 80}

CASES = {
    "every_nth": lambda df, **s: records.every_nth(df, 5, **s),
    "running_energy": lambda df, **s: energy.running_energy(df, **s),
    "energy_totals": lambda df, **s: energy.energy_totals(df, **s),
    "energy_trend": lambda df, **s: energy.energy_trend(df, **s),
    "energy_audit": lambda df, **s: energy.energy_audit(df, **s),
    "session_summary": lambda df, **s: energy.session_summary(df, 60, **s),
    "moving_average": lambda df, **s: features.moving_average_scores(df, **s),
    "detect": lambda df, **s: anomaly.detect(df, anomaly.train_stats(df), **s),
    "sliding_features": lambda df, **s: features.sliding_features(df, **s),
    "tumbling_features": lambda df, **s: features.tumbling_features(df, **s),
    "chrono_split": lambda df, **s: forecast.chrono_split(df, **s),
    "fit_trend": lambda df, **s: forecast.fit_trend(df, **s)[0],
    "fit_seasonal": lambda df, **s: forecast.fit_trend(df, **s)[1],
    "stratified_split": lambda df, **s: faults.stratified_split(df, limit=s.get("limit")),
    "report_daily": lambda df, **s: reports.report(df, "daily", **s),
    "ewma": lambda df, **s: adc.ewma_snap(_with_zeros(df), **s),
    "drop_repeated": lambda df, **s: parse.drop_repeated(df.withColumn("ts", F.date_trunc("hour", "ts")), **s),
}


def _with_zeros(df):
    small = F.when(F.col("seq") % 4 > 0, F.lit(0.0))
    return df.withColumns({c: small.otherwise(F.col(c) / 20) for c in ("voltage", "current")})


@pytest.mark.parametrize("name", sorted(CASES))
def test_split_gives_the_same(small, name):
    whole, parts = frame(CASES[name](small)), frame(CASES[name](small, **SPLIT))
    assert len(whole) > 0
    assert_frame_equal(whole, parts, rtol=1e-9, atol=1e-9)


def test_split_sequences(small):
    def shape(df):
        return frame(df.select("device_id", "seq", F.to_json("inputs").alias("x"), F.to_json("targets").alias("y")))

    assert_frame_equal(
        shape(forecast.frame_sequences(small)), shape(forecast.frame_sequences(small, **WIDE))
    )


@pytest.mark.parametrize("n", [1, 7, 60, 5000])
def test_two_step_latest(spark, small, n):
    spread = small.repartition(7)
    assert_frame_equal(frame(ordered.latest(spread, n)), frame(ordered.latest(spread, n, limit=5)))


def test_newest_of_a_busy_device_are_few_before_the_rank(spark):
    """Without any limit on ranks in map tasks, and with ties at the cutoff: what is ranked is a small part, and has the newest rows."""
    at = F.timestamp_seconds(F.floor(F.col("id") / 3) + 1_700_000_000).cast("timestamp_ntz")
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 1000).otherwise(-1).alias("device_id"), F.col("id").alias("seq"), at.alias("ts"))
    df = materialize(df.orderBy(F.xxhash64("seq")), "busy")
    left = ordered.recent_part(df, 50, ("device_id",), "ts", 5_000)
    sizes = {r["device_id"]: r["n"] for r in left.groupBy("device_id").agg(F.count("*").alias("n")).collect()}
    assert 50 <= sizes[-1] <= 2_500 and all(sizes[k] == 30 for k in sizes if k >= 0)
    held = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "-1")
    try:
        found = ordered.latest(df, 50, limit=5_000).filter("device_id = -1").collect()
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", held)
    busy = sorted((r["seq"] for r in df.filter("device_id = -1").collect()), reverse=True)[:50]
    assert {r["seq"]: r["age"] for r in found} == {s: n for n, s in enumerate(busy, start=1)}


def test_latest_is_cut_before_the_shuffle(small):
    plan = ordered.latest(small, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_chunks_are_bounded_and_positions_dense(spark):
    df = tables.readings_coarse(spark, SMALL).withColumn("device_id", F.lit(1))
    s = ordered.ordered(df, behind=29, limit=100, chunk=64)
    sizes = s.df.groupBy(*s.part).count().agg(F.max("count")).first()[0]
    assert s.split and sizes <= 64 + 29
    positions = [r.pos for r in s.own(s.df).orderBy("ts", "seq").select("pos").collect()]
    assert positions == list(range(1, len(positions) + 1))


def test_frames_may_not_pass_a_chunk(small):
    with pytest.raises(ValueError):
        ordered.ordered(small, behind=29, limit=20, chunk=16)


def test_window_plan_has_one_shuffle_and_one_sort(small):
    s = ordered.ordered(small, behind=29)
    plan = s.own(s.df.withColumn("m", F.avg("power").over(s.rows(-29, -1))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert plan.count("Sort [") == 1


def test_scan_reads_only_needed_columns(spark):
    plan = energy.signal_stats(tables.readings(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in plan and "event_id" in plan.split("ReadSchema")[1]
