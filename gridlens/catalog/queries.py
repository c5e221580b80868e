"""Registered batch queries over the driver's tables. All doubles are rounded to four decimals
unless an operator rounds them itself, so that they compare exactly across engines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.catalog import trees
from gridlens.config import SIGNALS
from gridlens.functions import scalar as S
from gridlens.functions.numeric import half_up
from gridlens.operators import anomaly, bagging, boosting, energy, faults, features, forecast, forecaster, insights, learn, records, serving
from gridlens.operators import forest as learned_forest
from gridlens.plans import reports, scoring
from gridlens.session import materialize, scratch_path, tune
from gridlens.sources import adc, files, parse, tables
from gridlens.streaming import jobs, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(tune(spark), folder)

    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame, digits: int = 4, skip: tuple = ()) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in skip]
    return df.withColumns({c: half_up(c, digits) for c in doubles})


READING = ("device_id", "seq")


def readings(spark, folder):
    return tables.readings(spark, folder)


def coarse(spark, folder):
    return tables.readings_coarse(spark, folder)


def predicted(spark, folder):
    return tables.predictions(tables.readings(spark, folder))


def predicted_coarse(spark, folder):
    return tables.predictions(tables.readings_coarse(spark, folder))


# Sources and cleaning


@query
def parse_lines(spark, folder):
    return rounded(parse.parse_lines(tables.sensor_lines(spark, folder)))


@query
def parse_tagged_lines(spark, folder):
    lines = readings(spark, folder).select(
        "seq",
        F.when(F.col("seq") % 19 == 0, "Vrms: ? V")
        .otherwise(
            F.concat(
                F.lit("Vrms: "), F.col("voltage").cast("string"), F.lit(" V, Current: "), F.col("current").cast("string"),
                F.lit(" A, Power: "), F.col("power").cast("decimal(12,2)").cast("string"), F.lit(" W"),
            )
        )
        .alias("value"),
    )
    return parse.parse_tagged_lines(lines)


@query
def parse_json_payload(spark, folder):
    lines = readings(spark, folder).select(
        "seq",
        F.when(F.col("seq") % 13 == 0, "{broken").otherwise(F.to_json(F.struct(*SIGNALS))).alias("value"),
    )
    return parse.parse_json_payload(lines)


@query
def sanitize_fields(spark, folder):
    raw = predicted(spark, folder).select(
        "seq",
        F.when(F.col("seq") % 11 == 0, "nan").when(F.col("seq") % 7 == 0, "x").otherwise((F.col("voltage") * 2).cast("string")).alias("voltage"),
        F.when(F.col("seq") % 5 == 0, "inf").otherwise((F.col("current") - 5).cast("string")).alias("current"),
        (F.col("power") * 20).cast("string").alias("power"),
        (F.col("confidence") * 2 - 0.5).cast("string").alias("confidence"),
    )
    return rounded(parse.sanitize_fields(raw, {"voltage": 0.0, "current": 0.0, "power": 0.0, "confidence": 1.0}))


@query
def drop_test_rows(spark, folder):
    flagged = readings(spark, folder).select(
        *READING, F.when(F.col("seq") % 9 == 0, F.lit(True)).when(F.col("seq") % 4 == 0, F.lit(False)).alias("test_mode")
    )
    return parse.drop_test_rows(flagged).select(*READING)


@query
def drop_repeated(spark, folder):
    minutes = readings(spark, folder).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    coarse_device = minutes.withColumn("device_id", F.col("device_id") % 10)
    return parse.drop_repeated(coarse_device).select(*READING, "ts")


@query
def adc_to_rms(spark, folder):
    return rounded(adc.adc_to_rms(tables.adc_samples(spark, folder), window_ms=1000))


def _noisy(df):
    """Readings with many zeros, which smoothing may snap to."""
    changed = df.withColumns(
        {
            "current": F.when(F.col("seq") % 3 > 0, F.lit(0.0)).otherwise(F.col("current") / 10),
            "voltage": F.when(F.col("seq") % 5 > 0, F.lit(0.0)).otherwise(F.col("voltage") / 10),
        }
    )
    return changed.select("device_id", "seq", "ts", "voltage", "current")


@query
def ewma_snap(spark, folder):
    out = adc.ewma_snap(_noisy(readings(spark, folder)))
    return rounded(out.select(*READING, "smooth_voltage", "smooth_current"))


@query
def settings(spark, folder):
    raw = readings(spark, folder).select(
        F.col("seq").alias("device_id"),
        F.when(F.col("seq") % 6 == 0, "bad").otherwise((F.col("current") * 10 - 1).cast("string")).alias("cost_per_kwh"),
        (F.col("voltage") * 2.2).cast("string").alias("voltage_high"),
        (F.col("voltage") - 160).cast("string").alias("voltage_low"),
        (F.col("current") * 7).cast("string").alias("current_max"),
        F.when(F.col("seq") % 8 == 0, F.lit(None).cast("string")).otherwise((F.col("power") * 15).cast("string")).alias("power_max"),
        F.when(F.col("seq") % 4 == 0, "").when(F.col("seq") % 4 == 1, "EURO").otherwise("£").alias("currency"),
    )
    return rounded(parse.settings_table(raw))


def _device_settings(spark, folder):
    """Settings that devices changed now and then, the first device never and one from the start."""
    raw = readings(spark, folder).filter("seq % 9 = 0 AND device_id % 10 <> 0").select(
        "device_id",
        F.when(F.col("device_id") % 10 != 1, F.col("ts")).alias("valid_from"),
        F.floor("current").cast("string").alias("cost_per_kwh"),
        (F.floor("voltage") + 5).cast("string").alias("voltage_high"),
        F.when(F.col("seq") % 2 == 0, "unknown").otherwise((F.floor("voltage") - 20).cast("string")).alias("voltage_low"),
        F.floor(F.col("current") + 2).cast("string").alias("current_max"),
        F.floor(F.col("power") / 2).cast("string").alias("power_max"),
        F.when(F.col("seq") % 4 == 1, "EURO").otherwise("£").alias("currency"),
    )
    return parse.settings_table(raw.filter("device_id % 10 <> 1 OR seq % 27 = 0"))


@query
def alerts_with_settings(spark, folder):
    return records.threshold_alerts(readings(spark, folder), _device_settings(spark, folder))


@query
def energy_audit_with_settings(spark, folder):
    return energy.energy_audit(readings(spark, folder), _device_settings(spark, folder))


@query
def energy_report_with_settings(spark, folder):
    return energy.energy_report(readings(spark, folder), _device_settings(spark, folder))


# Records and table maintenance


def _recorded(spark, folder):
    """Predictions with the columns a record needs."""
    return predicted(spark, folder).withColumns(
        {
            "is_anomaly": S.is_anomaly("anomaly_score"),
            "energy_kwh": F.col("power") / 7000,
            "health_score": F.lit(100.0) - F.col("anomaly_score") * 70,
            "health_label": S.health_label(F.lit(100.0) - F.col("anomaly_score") * 70),
        }
    )


@query
def build_record(spark, folder):
    r = records.build_record(_recorded(spark, folder))
    return r.select(
        *READING, "timestamp", *SIGNALS, "energy_kwh",
        "anomaly.is_anomaly", F.col("anomaly.score").alias("anomaly_score"),
        "fault.fault_id", "fault.fault_name", "fault.confidence",
        F.col("health.score").alias("health_score"), F.col("health.label").alias("health_label"),
    )


@query
def latest_reading(spark, folder):
    return records.latest_reading(readings(spark, folder))


@query
def every_nth(spark, folder):
    return records.every_nth(readings(spark, folder), 5).select(*READING, "ts", "power", "pos")


@query
def alert_record(spark, folder):
    return records.alert_record(_recorded(spark, folder))


@query
def retain_last(spark, folder):
    return records.retain_last(coarse(spark, folder), 500).select(*READING, "ts", "power")


@query
def session_summary(spark, folder):
    return energy.session_summary(readings(spark, folder), gap_minutes=360)


@query
def perf_snapshot(spark, folder):
    log = tables.inference_log(spark, folder)
    return serving.perf_snapshot(serving.latency_stats(log), log)


@query
def report_daily(spark, folder):
    return reports.report(readings(spark, folder), "daily")


@query
def report_monthly(spark, folder):
    return reports.report(readings(spark, folder), "monthly")


@query
def report_full(spark, folder):
    return reports.report(readings(spark, folder), "full")


@query
def report_summary(spark, folder):
    return reports.report_summary(readings(spark, folder))


@query
def recent(spark, folder):
    return records.recent(readings(spark, folder), 80)


@query
def merge_alerts_into_log(spark, folder):
    rows = _recorded(spark, folder)
    # Every fourth line of the log tells of an alert already.
    log = records.reading_log(rows, 20).withColumn("is_alert", F.col("seq") % 4 == 0)
    return records.merge_alerts_into_log(log, records.alert_record(rows)).drop("ts")


# Expressions on single readings


@query
def point_features(spark, folder):
    return rounded(readings(spark, folder).withColumns(S.point_features()).drop("ts"))


@query
def power_factor(spark, folder):
    return readings(spark, folder).select(*READING, half_up(S.power_factor(), 3).alias("power_factor"))


@query
def load_status(spark, folder):
    return readings(spark, folder).select(
        *READING, S.load_status4().alias("status4"), S.load_status3().alias("status3"), S.log_level().alias("level")
    )


@query
def gauge_ratio(spark, folder):
    return readings(spark, folder).select(
        *READING,
        *[half_up(S.gauge_ratio(s, top), 4).alias(f"{s}_ratio") for s, top in (("voltage", 250), ("current", 12), ("power", 2000))],
    )


@query
def threshold_score(spark, folder):
    return readings(spark, folder).select(*READING, half_up(S.threshold_score(), 4).alias("score"))


@query
def zscore_score(spark, folder):
    r = coarse(spark, folder)
    return rounded(anomaly.with_zscore(r, anomaly.train_stats(r)).select(*READING, "zscore"))


@query
def zscore_alerts(spark, folder):
    r = coarse(spark, folder)
    return anomaly.zscore_alerts(r, anomaly.train_stats(r)).select(*READING, "signal", "level", "message")


@query
def threshold_alerts(spark, folder):
    return records.threshold_alerts(readings(spark, folder))


@query
def model_alerts(spark, folder):
    return records.model_alerts(predicted(spark, folder))


@query
def fault_lookup(spark, folder):
    ids = predicted(spark, folder).withColumn("code", (F.col("fault_id") + F.col("seq") % 4).cast("int"))
    return ids.select(
        *READING, "code", S.fault_name("code").alias("fault_name"), S.fault_title("code").alias("fault_title"),
        S.fault_severity("code").alias("severity"),
    )


@query
def health_labels(spark, folder):
    score = F.col("voltage") - 160
    return readings(spark, folder).select(
        *READING, S.health_label(score).alias("label"), S.health_color(score).alias("color"), S.health_color3(score).alias("color3")
    )


@query
def forest_score(spark, folder):
    decision = predicted(spark, folder).withColumn("d", F.col("confidence") * 3 - 1.5)
    return rounded(
        decision.select(
            *READING, S.forest_score("d").alias("score"), S.forest_score("d", capped=True).alias("served_score"),
            (F.col("d") < 0).alias("is_anomaly"),
        )
    )


@query
def ensemble_anomaly(spark, folder):
    r = readings(spark, folder)
    found = anomaly.detect(r, anomaly.train_stats(r))
    return rounded(found.select(*READING, "threshold", "zscore", "moving_avg", "score", "is_anomaly"))


@query
def soft_vote(spark, folder):
    p = predicted(spark, folder).select(
        *READING,
        F.when(F.col("seq") % 10 != 3, F.array(F.col("confidence"), F.col("anomaly_score"), F.col("power") / 5000)).alias("rf"),
        F.when(F.col("seq") % 10 != 4, F.array(F.col("anomaly_score"), F.col("current") / 20, F.col("confidence"))).alias("gb"),
    )
    p = p.withColumn("gb", F.when(F.col("seq") % 10 != 3, F.col("gb")))
    voted = p.withColumn("prob", S.soft_vote("rf", "gb")).withColumn("top", S.top_classes("prob", 2))
    return rounded(
        voted.select(
            *READING,
            S.predicted_class("prob").alias("fault_id"),
            S.predicted_confidence("prob").alias("confidence"),
            F.coalesce(F.get("top", F.lit(0))["name"], F.lit("")).alias("first_name"),
            F.coalesce(F.get("top", F.lit(1))["prob"], F.lit(0.0)).alias("second_prob"),
        )
    )


@query
def cost(spark, folder):
    return readings(spark, folder).select(*READING, S.cost(F.col("power") / 1000).alias("cost"))


@query
def duration_hms(spark, folder):
    parts = S.duration_hms(F.col("power") * 13)
    return readings(spark, folder).select(*READING, *[c.alias(n) for n, c in parts.items()])


# Aggregates


@query
def signal_stats(spark, folder):
    return rounded(energy.signal_stats(readings(spark, folder)))


@query
def recent_signal_stats(spark, folder):
    return rounded(energy.recent_signal_stats(coarse(spark, folder), 80))


@query
def peaks(spark, folder):
    return energy.peaks(readings(spark, folder))


@query
def session_peak(spark, folder):
    r = readings(spark, folder)
    # The stored session of every second device ran at a higher load than the live one, others at a lower.
    factor = F.when(F.col("device_id") % 2 == 0, 1.1).otherwise(0.9)
    stored = energy.session_summary(r.withColumn("power", F.col("power") * factor), gap_minutes=100000)
    return energy.merge_session_peak(energy.peaks(r), stored).select("device_id", "peak_power", "peak_power_time")


@query
def running_energy(spark, folder):
    return rounded(energy.running_energy(readings(spark, folder)).select(*READING, "energy_kwh"))


@query
def energy_report(spark, folder):
    return energy.energy_report(readings(spark, folder))


@query
def load_profile(spark, folder):
    return energy.load_profile(readings(spark, folder))


@query
def power_distribution(spark, folder):
    return energy.power_distribution(readings(spark, folder))


@query
def energy_trend(spark, folder):
    return energy.energy_trend(readings(spark, folder))


@query
def energy_audit(spark, folder):
    return energy.energy_audit(readings(spark, folder))


@query
def alert_summary(spark, folder):
    return records.alert_summary(records.alerts(predicted_coarse(spark, folder)), 100)


@query
def anomaly_rate(spark, folder):
    flagged = predicted_coarse(spark, folder).withColumn("is_anomaly", S.is_anomaly("anomaly_score"))
    return rounded(anomaly.anomaly_rate(flagged, 100))


@query
def fault_distribution(spark, folder):
    return faults.fault_distribution(predicted_coarse(spark, folder), 100)


@query
def recurring_fault(spark, folder):
    return faults.recurring_fault(predicted(spark, folder))


@query
def label_distribution(spark, folder):
    return faults.label_distribution(tables.labelled(readings(spark, folder)))


@query
def efficiency_report(spark, folder):
    return insights.efficiency_report(readings(spark, folder))


@query
def health_components(spark, folder):
    facts = insights.device_summary(predicted(spark, folder))
    return rounded(facts.select("device_id", *[c.alias(n) for n, c in insights.health_components().items()]))


@query
def health_score(spark, folder):
    facts = insights.device_summary(predicted_coarse(spark, folder))
    return rounded(insights.health_score(facts))


@query
def cost_projection(spark, folder):
    return insights.cost_projection(energy.energy_totals(readings(spark, folder)))


@query
def latency_stats(spark, folder):
    return rounded(serving.latency_stats(tables.inference_log(spark, folder)))


@query
def latency_by_model(spark, folder):
    return rounded(serving.latency_by_model(tables.inference_log(spark, folder)))


@query
def latency_stats_floor(spark, folder):
    return rounded(serving.latency_stats_floor(tables.inference_log(spark, folder)))


@query
def classification_metrics(spark, folder):
    return rounded(faults.classification_metrics(faults.confusion(predicted(spark, folder))))


@query
def class_report(spark, folder):
    return rounded(faults.class_report(faults.confusion(predicted(spark, folder))).drop("hits"))


@query
def confusion_matrix(spark, folder):
    return faults.confusion_matrix(faults.confusion(predicted(spark, folder)))


@query
def insights_list(spark, folder):
    return insights.insights(predicted(spark, folder)).select("device_id", "rule", "category", "title", "severity")


@query
def recommendations(spark, folder):
    return insights.recommendations(readings(spark, folder)).select(
        "device_id", "position", "priority", "title", "category"
    )


@query
def active_alerts(spark, folder):
    return records.active_alerts(predicted(spark, folder))


# Windows


def _features(spark, folder, names):
    found = features.sliding_features(readings(spark, folder), names=names)
    return rounded(found.select(*READING, *names))


@query
def stat_features(spark, folder):
    return _features(spark, folder, features.STAT_NAMES)


@query
def trend_features(spark, folder):
    return _features(spark, folder, features.TREND_NAMES)


@query
def domain_features(spark, folder):
    return _features(spark, folder, features.DOMAIN_NAMES)


@query
def cross_features(spark, folder):
    return _features(spark, folder, features.CROSS_NAMES)


@query
def stability_features(spark, folder):
    return _features(spark, folder, features.STABILITY_NAMES)


@query
def moving_avg_score(spark, folder):
    return rounded(features.moving_average_scores(readings(spark, folder)).select(*READING, "moving_avg"))


@query
def feature_vector(spark, folder):
    return _features(spark, folder, features.FEATURE_NAMES)


@query
def sliding_features(spark, folder):
    found = features.sliding_features(coarse(spark, folder))
    names = ["voltage_mean", "current_q75", "power_skew", "power_trend_slope", "reactive_power", "ip_correlation", "power_stability_idx"]
    return rounded(found.select(*READING, "pos", *names))


@query
def tumbling_features(spark, folder):
    found = features.tumbling_features(tables.labelled(readings(spark, folder)))
    return rounded(found)


@query
def align_labels(spark, folder):
    found = features.sliding_features(tables.labelled(readings(spark, folder)), names=["power_mean"])
    return rounded(features.label_columns(found).select(*READING, "fault_label", "label", "power_mean"))


@query
def rolling_series(spark, folder):
    return records.rolling_series(coarse(spark, folder), 80).select(*READING, "x", *SIGNALS)


@query
def frame_sequences(spark, folder):
    framed = forecast.frame_sequences(coarse(spark, folder))
    return rounded(
        framed.select(
            *READING,
            F.size("inputs").alias("inputs"),
            F.col("inputs")[0]["power"].alias("first_power"),
            F.col("inputs")[59]["voltage"].alias("last_voltage"),
            F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x["current"]).alias("sum_current"),
            F.col("targets")[0].alias("first_target"),
            F.col("targets")[14].alias("last_target"),
        )
    )


@query
def power_trend(spark, folder):
    return rounded(forecast.trend(coarse(spark, folder)))


@query
def recent_latencies(spark, folder):
    return rounded(serving.recent_latencies(tables.inference_log(spark, folder)).select(*READING, "x", "latency_ms", "scaled"))


# Fitting


@query
def train_stats(spark, folder):
    return rounded(anomaly.train_stats(readings(spark, folder)))


@query
def minmax_scale(spark, folder):
    r = readings(spark, folder)
    ranges = forecast.signal_ranges(r)
    scaled = forecast.minmax_scale(r, ranges).join(ranges, "device_id")
    restored = forecast.minmax_restore(F.col("power_scaled")).alias("restored")
    return rounded(scaled.select(*READING, *[f"{s}_scaled" for s in SIGNALS], restored))


@query
def stratified_split(spark, folder):
    return faults.stratified_split(tables.labelled(readings(spark, folder)), key=("seq",)).select(*READING, "fault_label", "is_test")


@query
def chrono_split(spark, folder):
    return forecast.chrono_split(readings(spark, folder)).select(*READING, "is_train")


@query
def fit_trend(spark, folder):
    fits, _ = forecast.fit_trend(coarse(spark, folder))
    return rounded(fits, 6)


@query
def fit_seasonal(spark, folder):
    _, seasons = forecast.fit_trend(coarse(spark, folder))
    return rounded(seasons)


@query
def power_forecast(spark, folder):
    r = coarse(spark, folder)
    return rounded(forecast.forecast(r, *forecast.fit_trend(r)), 3).select("device_id", "step", "forecast")


@query
def forecast_interval(spark, folder):
    r = coarse(spark, folder)
    return rounded(forecast.forecast(r, *forecast.fit_trend(r), origin="series"), 3)


@query
def extend_forecast(spark, folder):
    r = coarse(spark, folder)
    fits, seasons = forecast.fit_trend(r)
    return rounded(forecast.extend_forecast(forecast.forecast(r, fits, seasons), fits, 24), 3)


@query
def standardize(spark, folder):
    names = list(features.FEATURE_NAMES)
    windows = materialize(features.sliding_features(readings(spark, folder)), "windows")
    scaled = learn.Scaler.fit(windows, names).transform(windows)
    shown = ["voltage_mean", "voltage_std", "current_skew", "power_trend_slope", "is_power_safe"]
    return rounded(scaled.select(*READING, *shown), 3)


def _training_windows(spark, folder):
    """Windows with labels, split into train and test parts, both scaled by the train part."""
    windows = scoring.training_windows(tables.labelled(readings(spark, folder)))
    return learn.Scaler.fit(windows.filter("NOT is_test"), features.FEATURE_NAMES).transform(windows)


def _test_metrics(test, predicted_id):
    found = faults.confusion(test.withColumn("fault_id", predicted_id.cast("int")))
    return rounded(faults.classification_metrics(found))


@query
def isolation_forest(spark, folder):
    windows = _training_windows(spark, folder)
    forest = learned_forest.fit_isolation_forest(windows, features.FEATURE_NAMES)
    return rounded(forest.decide(windows).select(*READING, "decision", (F.col("decision") < 0).alias("is_anomaly")))


@query
def detector_train_metrics(spark, folder):
    windows = _training_windows(spark, folder)
    forest = learned_forest.fit_isolation_forest(windows, features.FEATURE_NAMES)
    return rounded(learned_forest.detector_metrics(forest.decide(windows)))


def _given_trees():
    columns = ["tree", "node", "feature", "border", "below", "above", "length", "gain", "weights"]
    return pd.DataFrame(trees.nodes(), columns=columns)


def _given_detector():
    forest = learned_forest.IsolationForest.from_nodes(_given_trees(), SIGNALS, trees.SAMPLE)
    forest.offset = trees.OFFSET
    return forest


@query
def forest_decisions(spark, folder):
    """Decisions of a detector whose trees are given."""
    scored = _given_detector().decide(readings(spark, folder))
    return rounded(scored.select(*READING, "decision", (F.col("decision") < 0).alias("is_outlier")))


@query
def forest_metrics(spark, folder):
    """Size, anomalies and scores of a table scored by given trees."""
    return rounded(learned_forest.detector_metrics(_given_detector().decide(readings(spark, folder))))


def _given_classifiers():
    nodes = _given_trees()
    shares = nodes["weights"].map(lambda w: [x / sum(w) for x in w])
    forest = bagging.Bagged.from_table(nodes.assign(shares=shares), SIGNALS, trees.LEVELS)
    labels = [0, 3, 4, 7]
    nodes["value"] = nodes["weights"].map(lambda w: (w[0] - w[1]) / 10)
    return forest, boosting.Boosted.from_table(nodes, SIGNALS, labels, [0.1 * k for k in labels], trees.LEVELS)


@query
def forest_votes(spark, folder):
    """Faults by the vote of a forest and of boosted trees that are given."""
    found = learn.vote(learn.probabilities(readings(spark, folder), *_given_classifiers()))
    return rounded(found.select(*READING, "fault_id", "confidence", F.col("top")[0]["name"].alias("first_name"), F.col("top")[1]["prob"].alias("second_prob")))


@query
def random_forest(spark, folder):
    windows = _training_windows(spark, folder)
    model = learn.fit_random_forest(windows.filter("NOT is_test"), features.FEATURE_NAMES)
    return _test_metrics(learn.probabilities(windows.filter("is_test"), forest=model), S.predicted_class("rf"))


@query
def gradient_boosting(spark, folder):
    windows = _training_windows(spark, folder)
    model = learn.fit_boosted(windows.filter("NOT is_test"), features.FEATURE_NAMES)
    return _test_metrics(learn.probabilities(windows.filter("is_test"), boosted=model), S.predicted_class("gb"))


@query
def vote_metrics(spark, folder):
    """Quality of the vote of both classifiers on held-out windows."""
    return rounded(faults.classification_metrics(scoring.vote_confusion(tables.labelled(readings(spark, folder)))))


@query
def cross_validate(spark, folder):
    windows = _training_windows(spark, folder)
    return learn.cross_validate(windows.filter("NOT is_test"), features.FEATURE_NAMES)


@query
def feature_importance(spark, folder):
    windows = _training_windows(spark, folder)
    model = learn.fit_random_forest(windows.filter("NOT is_test"), features.FEATURE_NAMES)
    return learn.feature_importance(spark, model)


@query
def learned_forecaster(spark, folder):
    rows = coarse(spark, folder)
    return forecaster.forecaster_metrics(rows, forecaster.fit_forecaster(rows))


@query
def learned_forecast(spark, folder):
    """The next 24 steps of every device, by a forecaster that was saved and loaded again."""
    rows, path = coarse(spark, folder), scratch_path(spark, "forecaster")
    forecaster.fit_forecaster(rows).save(spark, path)
    return rounded(forecaster.Forecaster.load(spark, path).forecast(rows, 24), 3)


@query
def score_readings(spark, folder):
    rows = tables.labelled(readings(spark, folder))
    models = scoring.train(rows)
    scored = scoring.score_readings(rows, models)
    return scored.select(*READING, "score", "is_anomaly", "is_outlier", "fault_id", "fault_name", "confidence")


@query
def fit_or_load(spark, folder):
    """Scores with models that were saved and loaded again."""
    rows = tables.labelled(readings(spark, folder))
    path = scratch_path(spark, "models")
    scoring.fit_or_load(spark, path, rows)
    models = scoring.fit_or_load(spark, path, rows)
    return scoring.score_readings(rows, models).select(*READING, "score", "is_outlier", "fault_id")


@query
def append_and_read_log(spark, folder):
    path = scratch_path(spark, "log")
    files.append_log(readings(spark, folder).filter("power < 500"), path)
    files.append_log(readings(spark, folder).filter("power >= 500"), path)
    return files.read_log(spark, path).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query
def write_and_read_dataset(spark, folder):
    path = scratch_path(spark, "dataset")
    rows = tables.labelled(readings(spark, folder)).withColumn("fault_name", S.fault_name("fault_label"))
    files.write_dataset(rows, path)
    return files.read_dataset(spark, path).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# Streams, run over all input there is


def _stream(spark, folder, name):
    # As a pattern, the path may be a single file.
    return jobs.read_stream(spark, f"{folder}/{name}.parque[t]", tables.table(spark, folder, name).schema)


def _reading_stream(spark, folder):
    return tables.as_readings(_stream(spark, folder, "events"))


@query
def stream_readings(spark, folder):
    raw = _reading_stream(spark, folder)
    lines = raw.select(
        "seq",
        F.when(F.col("seq") % 17 == 0, "noise")
        .otherwise(F.concat(F.col("voltage").cast("string"), F.lit(","), F.col("current").cast("string")))
        .alias("value"),
    )
    return rounded(jobs.run_to_table(jobs.reading_stream(lines)))


@query
def stream_running_stats(spark, folder):
    found = jobs.run_to_table(state.running_stats(_reading_stream(spark, folder)))
    final = records.latest_reading(found, order=("pos",))
    times = {f"peak_{s}_time": F.timestamp_micros(f"peak_{s}_us").cast("timestamp_ntz") for s in SIGNALS}
    spread = [f"{s}_{n}" for s in SIGNALS for n in ("min", "avg", "max")]
    shown = final.withColumns(times).withColumnRenamed("pos", "samples")
    return rounded(shown.select("device_id", "samples", "energy_kwh", *spread, *[f"peak_{s}" for s in SIGNALS], *times))


@query
def stream_features(spark, folder):
    names = list(features.FEATURE_NAMES)
    found = jobs.run_to_table(state.window_features(_reading_stream(spark, folder)))
    return rounded(found.select(*READING, *names))


@query
def stream_scores(spark, folder):
    """Windows of a stream scored with models trained on the table."""
    models = scoring.train(tables.labelled(readings(spark, folder)))
    scored = scoring.score_windows(state.window_features(_reading_stream(spark, folder)), models)
    return rounded(jobs.run_to_table(scored.select(*READING, "decision", "fault_id", "confidence")))


@query
def stream_ewma(spark, folder):
    found = jobs.run_to_table(state.ewma(_noisy(_reading_stream(spark, folder))))
    return rounded(found.select(*READING, "smooth_voltage", "smooth_current"))


@query
def stream_adc(spark, folder):
    samples = tables.as_adc_samples(_stream(spark, folder, "lineitem"))
    return rounded(jobs.adc_stream(samples, window_ms=1000))


@query
def stream_alerts(spark, folder):
    return jobs.run_to_table(jobs.alert_stream(tables.predictions(_reading_stream(spark, folder))))


@query
def stream_sessions(spark, folder):
    return jobs.session_stream(_reading_stream(spark, folder), 360)


@query
def stream_drop_repeated(spark, folder):
    hourly = _reading_stream(spark, folder).withColumns(
        {"ts": F.date_trunc("hour", "ts").cast("timestamp_ntz"), "device_id": F.col("device_id") % 10}
    )
    return jobs.run_to_table(state.drop_repeated(hourly)).select(*READING, "ts")


def _stream_tables(spark, folder):
    """The maintained tables after a stream of scored readings."""
    scored = tables.predictions(state.running_stats(_reading_stream(spark, folder)))
    scored = scored.withColumn("is_anomaly", S.is_anomaly("anomaly_score"))
    kept = jobs.Tables(spark, scratch_path(spark, "tables"), perf_log=tables.inference_log(spark, folder))
    kept.start(scored, scratch_path(spark, "tables-checkpoint")).awaitTermination()
    return kept


@query
def stream_live_table(spark, folder):
    live = _stream_tables(spark, folder).read("live")
    return live.select(*READING, "timestamp", *SIGNALS, "energy_kwh", "fault.fault_name", "anomaly.is_anomaly")


@query
def stream_history_table(spark, folder):
    return _stream_tables(spark, folder).read("readings").select(*READING, "timestamp", *SIGNALS)


@query
def stream_session_table(spark, folder):
    return rounded(_stream_tables(spark, folder).read("session"))


@query
def stream_health_table(spark, folder):
    return rounded(_stream_tables(spark, folder).read("health").select("device_id", "pos", "overall_score", "label"))


@query
def stream_recommendations(spark, folder):
    found = _stream_tables(spark, folder).read("recommendations")
    return found.select("device_id", "pos", "position", "priority", "title")
