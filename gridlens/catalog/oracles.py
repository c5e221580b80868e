"""SQL counterparts of the registered queries, written for an independent engine."""

from __future__ import annotations

from gridlens.catalog import trees
from gridlens.config import SIGNALS

# Names and severities by fault id, stated here as well so that a wrong one does not pass.
FAULT_NAMES = dict(enumerate(["Normal", "Overvoltage", "Undervoltage", "Overcurrent", "Overload", "Voltage Sag", "Voltage Swell",
                              "Power Factor Issue", "Harmonic Distortion", "Phase Imbalance"]))
FAULT_SEVERITY = dict(zip(FAULT_NAMES.values(), [0, 3, 3, 4, 5, 1, 2, 1, 2, 3]))

ORACLES: dict[str, str] = {}

VOLTS = "CAST(round(190 + 0.7 * CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), 2) AS DOUBLE)"


def r(x: str, digits: int = 4) -> str:
    """Round half up, with the same push at ties as the engine's own rounding."""
    return f"(CAST(floor(({x}) * {10**digits} + 0.500001e0) AS DOUBLE) / {10**digits})"


def text(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {r(x, digits)})"


def percent(x: str) -> str:
    return f"concat({text(f'({x}) * 100', 0)}, '%')"


def _readings(device: str) -> str:
    return f"""SELECT {device} AS device_id, event_id AS seq, ts, {VOLTS} AS voltage, round(value / 10, 3) AS current,
  CAST(floor({VOLTS} * round(value / 10, 3) * (0.60 + 0.004 * (event_id % 100)) * 100 + 0.500001) AS DOUBLE) / 100 AS power
FROM events"""


READINGS = _readings("user_id")
COARSE = _readings("user_id % 10")
LABEL = """CASE WHEN power > 3000 THEN 4 WHEN current > 15 THEN 3 WHEN voltage > 250 THEN 1 WHEN voltage < 200 THEN 2
  WHEN power < 0.7e0 * voltage * current THEN 7 WHEN voltage >= 241.5e0 THEN 6 WHEN voltage <= 211.6e0 THEN 5 ELSE 0 END"""


def labelled(base: str) -> str:
    return f"SELECT *, {LABEL} AS fault_label FROM ({base})"


def predictions(base: str) -> str:
    return f"""SELECT *, CASE WHEN seq % 7 = 0 THEN (fault_label + 1) % 10 ELSE fault_label END AS fault_id,
  CAST(seq % 100 AS DOUBLE) / 100 AS confidence, CAST(seq % 41 AS DOUBLE) / 50 AS anomaly_score FROM ({labelled(base)})"""


PREDICTED, PREDICTED_COARSE = predictions(READINGS), predictions(COARSE)

LOG = """SELECT user_id % 10 AS device_id, event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'anomaly_detector' WHEN 'view' THEN 'fault_rf' ELSE 'fault_gb' END AS model,
  round(value / 10, 3) AS latency_ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error FROM events"""

ADC = """SELECT l_suppkey % 10 AS device_id, l_orderkey * 10 + l_linenumber AS sample_ms,
  CAST(1200 + (l_partkey * 37 + l_linenumber * 101) % 1709 AS INT) AS raw_v,
  CAST(2000 + (l_partkey * 13 + l_linenumber * 7) % (CASE WHEN l_suppkey % 10 = 0 THEN 50 ELSE 300 END) AS INT) AS raw_i
FROM lineitem"""


def name_of(x: str, default: str = "'Unknown'") -> str:
    return f"(CASE {x} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULT_NAMES.items()) + f" ELSE {default} END)"


def severity_of(x: str) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN {k} THEN {FAULT_SEVERITY[v]}" for k, v in FAULT_NAMES.items()) + " ELSE 0 END)"


def newest(base: str, n: int, keys: str = "device_id", order: str = "ts DESC, seq DESC") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS age FROM ({base}))
WHERE age <= {n}"""


def parts(base: str) -> str:
    """Readings with the energy since the one before."""
    return f"""SELECT *, coalesce(power / 1000 * (((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY device_id ORDER BY ts, seq)) / 1e6) / 3600), 0) AS kwh
FROM ({base})"""


def metered(base: str) -> str:
    return f"SELECT *, sum(kwh) OVER (PARTITION BY device_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS energy_kwh FROM ({parts(base)})"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo!r}e0, least({hi!r}e0, {x}))".replace("e+06e0", "e6")


def sane(x: str, fallback: float, lo: float, hi: float) -> str:
    n = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {n} IS NULL OR NOT isfinite({n}) THEN {fallback!r}e0 ELSE greatest({lo!r}e0, least({hi!r}e0, {n})) END"


O = ORACLES

# Sources and cleaning

LINES = f"""SELECT seq, CASE WHEN seq % 17 = 0 THEN 'noise' WHEN seq % 23 = 0 THEN concat(CAST(voltage AS VARCHAR), ',')
  ELSE concat(CAST(voltage AS VARCHAR), ',', CAST(current AS VARCHAR)) END AS value FROM ({READINGS})"""
O["parse_lines"] = f"""WITH l AS ({LINES}),
p AS (SELECT seq, TRY_CAST(split_part(value, ',', 1) AS DOUBLE) AS v, TRY_CAST(split_part(value, ',', 2) AS DOUBLE) AS i FROM l)
SELECT seq, {r('v')} AS voltage, {r('i')} AS current, {r('v * i * 0.92e0')} AS power FROM p WHERE v IS NOT NULL AND i IS NOT NULL"""
O["parse_tagged_lines"] = f"SELECT seq, voltage, current, power FROM ({READINGS}) WHERE seq % 19 <> 0"
O["parse_json_payload"] = f"SELECT seq, voltage, current, power FROM ({READINGS}) WHERE seq % 13 <> 0"
O["sanitize_fields"] = f"""WITH t AS (SELECT seq,
  CASE WHEN seq % 11 = 0 THEN 'nan' WHEN seq % 7 = 0 THEN 'x' ELSE CAST(voltage * 2 AS VARCHAR) END AS v,
  CASE WHEN seq % 5 = 0 THEN 'inf' ELSE CAST(current - 5 AS VARCHAR) END AS i,
  CAST(power * 20 AS VARCHAR) AS p, CAST(confidence * 2 - 0.5e0 AS VARCHAR) AS c FROM ({PREDICTED}))
SELECT seq, {r(sane('v', 0.0, 0.0, 500.0))} AS voltage, {r(sane('i', 0.0, 0.0, 100.0))} AS current,
  {r(sane('p', 0.0, 0.0, 50000.0))} AS power, {r(sane('c', 1.0, 0.0, 1.0))} AS confidence FROM t"""
O["drop_test_rows"] = f"SELECT device_id, seq FROM ({READINGS}) WHERE seq % 9 <> 0"
O["drop_repeated"] = f"""WITH t AS (SELECT device_id % 10 AS device_id, seq, date_trunc('hour', ts) AS ts FROM ({READINGS})),
m AS (SELECT *, lag(ts) OVER (PARTITION BY device_id ORDER BY seq) AS prev FROM t)
SELECT device_id, seq, CAST(ts AS TIMESTAMP) AS ts FROM m WHERE prev IS NULL OR prev <> ts"""


def _rms(raw: str, gain: str) -> str:
    swing = f"((max({raw}) - min({raw})) * (3.3e0 / 4095.0e0))"
    return f"CASE WHEN {swing} < 0.05e0 THEN 0e0 ELSE {swing} END / 2 * 0.707e0 * {gain}"


O["adc_to_rms"] = f"""SELECT device_id, CAST(floor(sample_ms / 1000.0e0) * 1000 AS BIGINT) AS window_start_ms,
  {r(_rms('raw_v', '462.32e0'))} AS voltage, {r(_rms('raw_i', '20.61e0'))} AS current, count(*) AS samples
FROM ({ADC}) GROUP BY 1, 2"""


def _snap(s: str, x: str, snap: str) -> str:
    return f"CASE WHEN {x} = 0 AND {s} < {snap} THEN 0e0 ELSE 0.8e0 * {s} + 0.2e0 * {x} END"


O["ewma_snap"] = f"""WITH RECURSIVE t AS (SELECT device_id, seq, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS n,
  CASE WHEN seq % 3 > 0 THEN 0e0 ELSE current / 10 END AS x, CASE WHEN seq % 5 > 0 THEN 0e0 ELSE voltage / 10 END AS v FROM ({READINGS})),
s AS (SELECT device_id, seq, n, {_snap('0e0', 'x', '0.05e0')} AS si, {_snap('0e0', 'v', '5e0')} AS sv FROM t WHERE n = 1
  UNION ALL SELECT t.device_id, t.seq, t.n, {_snap('s.si', 't.x', '0.05e0')}, {_snap('s.sv', 't.v', '5e0')}
  FROM s JOIN t ON t.device_id = s.device_id AND t.n = s.n + 1)
SELECT device_id, seq, {r('sv')} AS smooth_voltage, {r('si')} AS smooth_current FROM s"""
O["settings"] = f"""WITH t AS (SELECT seq, CASE WHEN seq % 6 = 0 THEN 'bad' ELSE CAST(current * 10 - 1 AS VARCHAR) END AS c,
  CAST(voltage * 2.2e0 AS VARCHAR) AS vh, CAST(voltage - 160 AS VARCHAR) AS vl, CAST(current * 7 AS VARCHAR) AS cm,
  CASE WHEN seq % 8 = 0 THEN NULL ELSE CAST(power * 15 AS VARCHAR) END AS pm,
  CASE WHEN seq % 4 = 0 THEN '' WHEN seq % 4 = 1 THEN 'EURO' ELSE '£' END AS cur FROM ({READINGS}))
SELECT seq AS device_id, {r(sane('c', 6.5, 0.01, 100.0))} AS cost_per_kwh, {r(sane('vh', 250.0, 100.0, 500.0))} AS voltage_high,
  {r(sane('vl', 200.0, 50.0, 400.0))} AS voltage_low, {r(sane('cm', 15.0, 1.0, 100.0))} AS current_max,
  {r(sane('pm', 3000.0, 100.0, 50000.0))} AS power_max, CASE WHEN cur = '' THEN '₹' ELSE substr(cur, 1, 3) END AS currency FROM t"""

# Records and table maintenance


def health_label(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'Excellent' WHEN {x} >= 75 THEN 'Good' WHEN {x} >= 60 THEN 'Fair' WHEN {x} >= 40 THEN 'Poor' ELSE 'Critical' END"


HEALTH = "(100.0e0 - anomaly_score * 70)"
ANOMALOUS = "(anomaly_score > 1.0e0 - 0.7e0)"
O["build_record"] = f"""SELECT device_id, seq, ts AS timestamp, {r('voltage', 2)} AS voltage, {r('current', 3)} AS current,
  {r('power', 2)} AS power, {r('power / 7000', 6)} AS energy_kwh, {ANOMALOUS} AS is_anomaly, {r('anomaly_score')} AS anomaly_score,
  fault_id, {name_of('fault_id')} AS fault_name, {r('confidence')} AS confidence, {r(HEALTH, 1)} AS health_score,
  {health_label(HEALTH)} AS health_label FROM ({PREDICTED})"""
O["latest_reading"] = f"SELECT device_id, seq, ts, voltage, current, power FROM ({newest(READINGS, 1)})"
O["every_nth"] = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS pos FROM ({READINGS}))
SELECT device_id, seq, ts, power, pos FROM t WHERE pos % 5 = 0"""
ALERT_DETAIL = f"""CASE WHEN fault_id <> 0 THEN concat({name_of('fault_id')}, ' (', {percent('confidence')}, ')')
  ELSE concat('Anomaly score=', {text('anomaly_score', 3)}) END"""
ALERT_RECORDS = f"""SELECT device_id, seq, ts AS timestamp, CASE WHEN fault_id <> 0 THEN 'fault' ELSE 'anomaly' END AS type,
  {ALERT_DETAIL} AS detail, CASE WHEN fault_id IN (3, 4) THEN 'critical' ELSE 'warning' END AS severity,
  {r('voltage', 2)} AS voltage, {r('current', 3)} AS current, {r('power', 2)} AS power
FROM ({PREDICTED}) WHERE {ANOMALOUS} OR fault_id <> 0"""
O["alert_record"] = ALERT_RECORDS
O["retain_last"] = f"SELECT device_id, seq, ts, power FROM ({newest(COARSE, 500)})"


def sessions(base: str, minutes: int) -> str:
    return f"""WITH t AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY device_id ORDER BY ts, seq) AS wait FROM ({base})),
o AS (SELECT *, CASE WHEN wait IS NULL OR wait > {minutes * 60_000_000} THEN 1 ELSE 0 END AS opens FROM t),
s AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY device_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY device_id, session_no ORDER BY power DESC, ts, seq) AS pk FROM s)
SELECT device_id, session_no, min(ts) AS start_time, max(ts) AS end_time, count(*) AS sample_count,
  {r("sum(CASE WHEN opens = 1 THEN 0 ELSE power / 1000 * (wait / 1e6 / 3600) END)", 6)} AS energy_kwh,
  {r("greatest(max(power), 0)", 2)} AS peak_power_w, max(CASE WHEN pk = 1 AND power > 0 THEN ts END) AS peak_power_time
FROM p GROUP BY 1, 2"""


O["session_summary"] = sessions(READINGS, 360)

STATS = f"""WITH log AS ({LOG}), tot AS (SELECT device_id, count(*) AS total_inferences, sum(latency_ms) AS total_time_ms,
  (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS up, CAST(sum(is_error) AS BIGINT) AS error_count, max(ts) AS last_ts FROM log GROUP BY 1),
late AS ({newest('SELECT * FROM log', 2000)}),
sp AS (SELECT device_id, avg(latency_ms) AS a, min(latency_ms) AS lo, max(latency_ms) AS hi, quantile_cont(latency_ms, 0.5) AS p50,
  quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99, stddev_pop(latency_ms) AS sd FROM late GROUP BY 1)"""
O["perf_snapshot"] = f"""{STATS} SELECT device_id, last_ts AS timestamp, total_inferences, {r('a', 3)} AS avg_latency_ms,
  {r('p95', 3)} AS p95_latency_ms, {r('total_inferences / up', 2)} AS throughput_ips, error_count FROM tot JOIN sp USING (device_id)"""
STATUS3 = "CASE WHEN power > 3000 THEN 'Overload' WHEN power > 3000.0e0 * 0.7e0 THEN 'High' ELSE 'Normal' END"
LEVEL3 = "CASE WHEN power > 3000 THEN 'danger' WHEN power > 3000.0e0 * 0.7e0 THEN 'warning' ELSE 'normal' END"
STATUS4 = "CASE WHEN {0} > 3000 THEN 'OVERLOAD!' WHEN {0} > 3000.0e0 * 0.7e0 THEN 'HIGH LOAD' WHEN {0} > 3000.0e0 * 0.3e0 THEN 'NORMAL' ELSE 'LIGHT' END"
SECOND = "strftime({}, '%Y-%m-%d %H:%M:%S')"
O["report_daily"] = f"""WITH m AS ({metered(READINGS)}), d AS (SELECT *, CAST(max(ts) OVER (PARTITION BY device_id) AS DATE) AS last_day FROM m)
SELECT device_id, seq, {SECOND.format('ts')} AS timestamp, voltage AS voltage_v, current AS current_a, power AS power_w,
  {r('energy_kwh')} AS energy_kwh, {STATUS3} AS status FROM d WHERE CAST(ts AS DATE) = last_day"""
O["report_monthly"] = f"""WITH s AS (SELECT *, CAST(ts AS DATE) AS d FROM ({parts(READINGS)})),
p AS (SELECT *, row_number() OVER (PARTITION BY device_id, d ORDER BY power DESC, ts, seq) AS pk,
  max(d) OVER (PARTITION BY device_id) AS last_day FROM s)
SELECT device_id, CAST(d AS VARCHAR) AS day, {r('sum(kwh)')} AS energy_kwh, {r('sum(kwh) * 6.5e0', 2)} AS cost,
  greatest(max(power), 0) AS peak_power_w, max(CASE WHEN pk = 1 AND power > 0 THEN {SECOND.format('ts')} END) AS peak_power_time
FROM p WHERE date_trunc('month', d) = date_trunc('month', last_day) GROUP BY device_id, d"""


def summary(base: str, history: int = 3600, scored: bool = False) -> str:
    scores = """, count(*) FILTER (WHERE age <= 1000) AS scores,
  avg(CASE WHEN anomaly_score > 0.3e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE age <= 1000) AS anomalous""" if scored else ""
    return f"""SELECT device_id, count(*) AS n, avg(voltage) AS vm, stddev_pop(voltage) AS vs, avg(current) AS im, max(current) AS ix,
  avg(power) AS pm, stddev_pop(power) AS ps, min(power) AS pn, max(power) AS px,
  regr_slope(CASE WHEN age <= 60 THEN power END, CASE WHEN age <= 60 THEN -age END) AS slope{scores}
FROM ({newest(base, history)}) GROUP BY device_id"""


def totals(base: str) -> str:
    return f"""SELECT device_id, sum(kwh) AS kwh, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 3600 AS hours, count(*) AS samples
FROM ({parts(base)}) GROUP BY device_id"""


PF = "CASE WHEN vm * im > 0 THEN pm / (vm * im) ELSE {} END"
EFFICIENCY = f"""device_id, CASE WHEN samples >= 60 THEN 'ready' ELSE 'insufficient_data' END AS status, """ + ", ".join(
    f"CASE WHEN samples >= 60 THEN {x} END AS {n}"
    for n, x in {
        "session_duration_hours": r("hours", 2),
        "total_energy_kwh": r("kwh"),
        "total_cost": r("kwh * 6.5e0", 2),
        "avg_power_w": r("pm", 1),
        "peak_power_w": r("px", 1),
        "min_power_w": r("pn", 1),
        "power_factor": r(PF.format("0e0"), 3),
        "load_utilization_pct": r("pm / 3000.0e0 * 100", 1),
        "voltage_stability": r("100 - vs * 10", 1),
        "projected_daily_kwh": r("pm * 24 / 1000", 2),
        "projected_monthly_cost": r("pm * 24 * 30 / 1000 * 6.5e0", 2),
        "currency": "'₹'",
    }.items()
)
FACTS = f"WITH f AS (SELECT * FROM ({summary(READINGS)}) JOIN ({totals(READINGS)}) USING (device_id))"
ADVICE = f"""a AS (
  SELECT device_id, 2 AS rank, 0 AS rule, 'Gathering Data' AS title, 'info' AS category FROM f WHERE samples < 30
  UNION ALL SELECT device_id, 0, 1, 'Install Voltage Stabilizer', 'hardware' FROM f WHERE samples >= 30 AND n > 30 AND (vm > 250 OR vm < 200)
  UNION ALL SELECT device_id, 1, 2, 'Investigate Voltage Fluctuations', 'maintenance' FROM f WHERE samples >= 30 AND n > 30 AND vs > 8
  UNION ALL SELECT device_id, 0, 3, 'Reduce Peak Load', 'optimization' FROM f WHERE samples >= 30 AND n > 60 AND pm / 3000 > 0.7e0
  UNION ALL SELECT device_id, 1, 4, 'Stabilize Load Profile', 'optimization' FROM f WHERE samples >= 30 AND n > 60 AND ps > pm * 0.5e0
  UNION ALL SELECT device_id, 1, 5, 'Improve Power Factor', 'efficiency' FROM f WHERE samples >= 30 AND n > 30 AND {PF.format('1e0')} < 0.85e0
  UNION ALL SELECT device_id, 2, 6, 'Energy Saving Tips', 'savings' FROM f WHERE samples >= 30 AND kwh > 0.01e0)"""
O["report_full"] = f"""{FACTS}, {ADVICE}, t AS (SELECT device_id, string_agg(title, '; ' ORDER BY rank, rule) AS recommendations FROM a GROUP BY 1)
SELECT {EFFICIENCY}, coalesce(recommendations, '') AS recommendations FROM f LEFT JOIN t USING (device_id)"""


def peaks(base: str) -> str:
    ranked = ", ".join(f"row_number() OVER (PARTITION BY device_id ORDER BY {s} DESC, ts, seq) AS n_{s}" for s in SIGNALS)
    picked = ", ".join(
        f"greatest(max({s}), 0) AS peak_{s}, max(CASE WHEN n_{s} = 1 AND {s} > 0 THEN ts END) AS peak_{s}_time" for s in SIGNALS
    )
    return f"SELECT device_id, {picked} FROM (SELECT *, {ranked} FROM ({base})) GROUP BY device_id"


O["report_summary"] = f"""SELECT p.*, {r('kwh')} AS energy_kwh, {r('kwh * 6.5e0', 2)} AS cost
FROM ({peaks(READINGS)}) p JOIN ({totals(READINGS)}) t USING (device_id)"""
O["recent"] = f"SELECT * FROM ({READINGS}) ORDER BY ts DESC, seq DESC LIMIT 80"
O["merge_alerts_into_log"] = f"""WITH late AS ({newest(ALERT_RECORDS, 10, order='timestamp DESC, seq DESC')}),
log AS (SELECT *, {SECOND.format('ts')} AS time FROM ({newest(READINGS, 20)})),
one AS (SELECT *, row_number() OVER (PARTITION BY device_id, {SECOND.format('timestamp')} ORDER BY age) AS k FROM late),
lines AS (SELECT device_id, {SECOND.format('timestamp')} AS time, seq, voltage, current, power,
  CASE WHEN severity = 'critical' THEN 'danger' ELSE 'warning' END AS status, substr(concat(type, ': ', detail), 1, 40) AS status_text,
  TRUE AS is_alert, 0 AS part, -age AS rk FROM one WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM log WHERE log.device_id = one.device_id AND log.seq % 4 = 0
    AND log.time = {SECOND.format('one.timestamp')})
  UNION ALL SELECT device_id, time, seq, voltage, current, power, {LEVEL3}, {STATUS3}, seq % 4 = 0, 1, age FROM log),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY part, rk) AS INT) AS position FROM lines)
SELECT device_id, time, seq, voltage, current, power, status, status_text, is_alert, position FROM n WHERE position <= 200"""

# Expressions on single readings

O["point_features"] = f"""SELECT device_id, seq, {r('voltage')} AS voltage, {r('current')} AS current, {r('power')} AS power,
  {r('abs(voltage - 230) / 230 * 100')} AS voltage_deviation_pct, {r('current / 15 * 100')} AS current_load_pct,
  {r('power / 3000 * 100')} AS power_load_pct, {r('voltage * current')} AS apparent_power,
  {r('CASE WHEN voltage * current > 0 THEN power / (voltage * current) ELSE 0 END')} AS power_factor,
  {r('sqrt(greatest(voltage * current * (voltage * current) - power * power, 0))')} AS reactive_power,
  CASE WHEN voltage BETWEEN 200 AND 250 THEN 1e0 ELSE 0e0 END AS is_voltage_in_range,
  CASE WHEN current <= 15 THEN 1e0 ELSE 0e0 END AS is_current_safe, CASE WHEN power <= 3000 THEN 1e0 ELSE 0e0 END AS is_power_safe
FROM ({READINGS})"""
O["power_factor"] = f"""SELECT device_id, seq, {r('CASE WHEN voltage * current > 0 THEN power / (voltage * current) ELSE 0 END', 3)} AS power_factor
FROM ({READINGS})"""
O["load_status"] = f"SELECT device_id, seq, {STATUS4.format('power')} AS status4, {STATUS3} AS status3, {LEVEL3} AS level FROM ({READINGS})"
O["gauge_ratio"] = f"""SELECT device_id, seq, {r('least(voltage / 250, 1)')} AS voltage_ratio, {r('least(current / 12, 1)')} AS current_ratio,
  {r('least(power / 2000, 1)')} AS power_ratio FROM ({READINGS})"""
THRESHOLD = """least(CASE WHEN voltage > 250 THEN least((voltage - 250) / 25.0e0, 1) * 0.4e0
    WHEN voltage < 200 THEN least((200 - voltage) / 20.0e0, 1) * 0.4e0 ELSE 0e0 END
  + CASE WHEN current > 15 THEN least((current - 15) / 3.0e0, 1) * 0.3e0 ELSE 0e0 END
  + CASE WHEN power > 3000 THEN least((power - 3000) / 600.0e0, 1) * 0.3e0 ELSE 0e0 END, 1)"""
O["threshold_score"] = f"SELECT device_id, seq, {r(THRESHOLD)} AS score FROM ({READINGS})"


def zscores(base: str) -> str:
    means = ", ".join(f"avg({s}) AS {s}_m, stddev_pop({s}) AS {s}_s" for s in SIGNALS)
    zs = ", ".join(f"CASE WHEN {s}_s > 0 THEN abs({s} - {s}_m) / {s}_s END AS z_{s}" for s in SIGNALS)
    return f"SELECT b.*, {zs} FROM ({base}) b JOIN (SELECT device_id, {means} FROM ({base}) GROUP BY device_id) m USING (device_id)"


ZSCORE = (
    "coalesce((" + " + ".join(f"CASE WHEN z_{s} IS NULL THEN 0 ELSE least(z_{s} / 4, 1) END" for s in SIGNALS) + ") / nullif("
    + " + ".join(f"CASE WHEN z_{s} IS NULL THEN 0 ELSE 1 END" for s in SIGNALS) + ", 0), 0)"
)
O["zscore_score"] = f"SELECT device_id, seq, {r(ZSCORE)} AS zscore FROM ({zscores(COARSE)})"
O["zscore_alerts"] = f"WITH z AS ({zscores(COARSE)}) " + " UNION ALL ".join(
    f"""SELECT device_id, seq, '{s}' AS signal, CASE WHEN z_{s} > 3 THEN 'extreme' ELSE 'high' END AS level,
  concat('{s.title()} Z-score: ', {text(f'z_{s}', 2)}, ' (', CASE WHEN z_{s} > 3 THEN 'extreme' ELSE 'high' END, ')') AS message
FROM z WHERE z_{s} > 2"""
    for s in SIGNALS
)


def _alert(no: int, kind: str, message: str, severity: str, when: str) -> str:
    return f"""SELECT device_id, ts, seq, {no} AS alert_no, '{kind}' AS type, {message} AS message, '{severity}' AS severity FROM b WHERE {when}"""


LIMIT_ALERTS = " UNION ALL ".join(
    [
        _alert(1, "overvoltage", f"concat('⚡ OVERVOLTAGE: ', {text('voltage', 1)}, 'V (limit: 250.0V)')", "danger", "voltage > 250"),
        _alert(2, "undervoltage", f"concat('🔋 UNDERVOLTAGE: ', {text('voltage', 1)}, 'V (min: 200.0V)')", "danger", "voltage < 200"),
        _alert(3, "overcurrent", f"concat('🔥 OVERCURRENT: ', {text('current', 2)}, 'A (limit: 15.0A)')", "danger", "current > 15"),
        _alert(4, "overload", f"concat('💥 OVERLOAD: ', {text('power', 0)}, 'W (limit: 3000.0W)')", "danger", "power > 3000"),
    ]
)
MODEL_ALERTS = " UNION ALL ".join(
    [
        _alert(5, "anomaly", f"concat('🔍 ANOMALY DETECTED (score: ', {text('anomaly_score', 2)}, ')')", "warning", "anomaly_score > 0.7e0"),
        _alert(6, "fault", f"concat('🛠️ FAULT: ', {name_of('fault_id')}, ' (confidence: ', {percent('confidence')}, ')')", "warning",
               "fault_id <> 0 AND confidence > 0.7e0"),
    ]
)
O["threshold_alerts"] = f"WITH b AS ({READINGS}) {LIMIT_ALERTS}"

# Settings of each device, as they hold at each reading.
SETTINGS = f"""SELECT device_id, CASE WHEN device_id % 10 <> 1 THEN ts ELSE TIMESTAMP '1900-01-01' END AS valid_from,
  least(100, greatest(0.01e0, floor(current))) AS rate, least(500, greatest(100, floor(voltage) + 5)) AS v_high,
  CASE WHEN seq % 2 = 0 THEN 200e0 ELSE least(400, greatest(50, floor(voltage) - 20)) END AS v_low,
  least(100, greatest(1, floor(current + 2))) AS i_max, least(50000, greatest(100, floor(power / 2))) AS p_max,
  CASE WHEN seq % 4 = 1 THEN 'EUR' ELSE '£' END AS cur
FROM ({READINGS}) WHERE seq % 9 = 0 AND device_id % 10 <> 0 AND (device_id % 10 <> 1 OR seq % 27 = 0)"""
#: Of versions with the same time the largest values hold.
VERSIONS = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, valid_from
  ORDER BY rate DESC, v_high DESC, v_low DESC, i_max DESC, p_max DESC, cur DESC) AS k FROM ({SETTINGS})) WHERE k = 1"""


def configured(base: str) -> str:
    return f"""SELECT b.*, coalesce(rate, 6.5e0) AS rate, coalesce(v_high, 250e0) AS v_high, coalesce(v_low, 200e0) AS v_low, coalesce(i_max, 15e0) AS i_max,
  coalesce(p_max, 3000e0) AS p_max, coalesce(cur, '₹') AS cur
FROM ({base}) b ASOF LEFT JOIN ({VERSIONS}) v ON b.device_id = v.device_id AND b.ts >= v.valid_from"""


O["alerts_with_settings"] = f"WITH b AS ({configured(READINGS)}) " + " UNION ALL ".join(
    [
        _alert(1, "overvoltage", f"concat('⚡ OVERVOLTAGE: ', {text('voltage', 1)}, 'V (limit: ', v_high, 'V)')", "danger", "voltage > v_high"),
        _alert(2, "undervoltage", f"concat('🔋 UNDERVOLTAGE: ', {text('voltage', 1)}, 'V (min: ', v_low, 'V)')", "danger", "voltage < v_low"),
        _alert(3, "overcurrent", f"concat('🔥 OVERCURRENT: ', {text('current', 2)}, 'A (limit: ', i_max, 'A)')", "danger", "current > i_max"),
        _alert(4, "overload", f"concat('💥 OVERLOAD: ', {text('power', 0)}, 'W (limit: ', p_max, 'W)')", "danger", "power > p_max"),
    ]
)
O["model_alerts"] = f"WITH b AS ({PREDICTED}) {MODEL_ALERTS}"
O["fault_lookup"] = f"""WITH t AS (SELECT device_id, seq, CAST(fault_id + seq % 4 AS INT) AS code FROM ({PREDICTED}))
SELECT device_id, seq, code, {name_of('code')} AS fault_name, {name_of('code', "concat('Unknown Fault (', code, ')')")} AS fault_title,
  {severity_of('code')} AS severity FROM t"""
O["health_labels"] = f"""SELECT device_id, seq, {health_label('(voltage - 160)')} AS label,
  CASE WHEN voltage - 160 >= 90 THEN '#22c55e' WHEN voltage - 160 >= 75 THEN '#34d399' WHEN voltage - 160 >= 60 THEN '#eab308'
    WHEN voltage - 160 >= 40 THEN '#f97316' ELSE '#ef4444' END AS color,
  CASE WHEN voltage - 160 >= 85 THEN '#22c55e' WHEN voltage - 160 >= 60 THEN '#eab308' ELSE '#ef4444' END AS color3 FROM ({READINGS})"""
O["forest_score"] = f"""WITH t AS (SELECT device_id, seq, confidence * 3 - 1.5e0 AS d FROM ({PREDICTED}))
SELECT device_id, seq, {r('greatest(0, -d)')} AS score, {r('least(1, greatest(0, -d))')} AS served_score, d < 0 AS is_anomaly FROM t"""


def moving(base: str) -> str:
    w = "PARTITION BY device_id ORDER BY ts, seq"
    means = ", ".join(f"avg({s}) OVER ({w} ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING) AS b_{s}" for s in SIGNALS)
    devs = " + ".join(f"least(abs({s} - b_{s}) / CASE WHEN b_{s} > 0 THEN b_{s} ELSE 1 END * 5, 1)" for s in SIGNALS)
    return f"""SELECT *, CASE WHEN pos >= 10 THEN ({devs}) / 3 ELSE 0e0 END AS moving_avg
FROM (SELECT *, row_number() OVER ({w}) AS pos, {means} FROM ({base}))"""


O["moving_avg_score"] = f"SELECT device_id, seq, {r('moving_avg')} AS moving_avg FROM ({moving(READINGS)})"
O["ensemble_anomaly"] = f"""WITH t AS (SELECT device_id, seq, {THRESHOLD} AS th, {ZSCORE} AS z, moving_avg AS ma FROM ({moving(zscores(READINGS))})),
e AS (SELECT *, th * 0.3e0 + z * 0.25e0 + 0.0e0 * 0.3e0 + ma * 0.15e0 AS score FROM t)
SELECT device_id, seq, {r('th')} AS threshold, {r('z')} AS zscore, {r('ma')} AS moving_avg, {r('score')} AS score,
  score > 1.0e0 - 0.7e0 AS is_anomaly FROM e"""


def _vote(x: str, y: str) -> str:
    return f"CASE WHEN seq % 10 = 3 THEN NULL WHEN seq % 10 = 4 THEN {x} ELSE {x} * 0.55e0 + {y} * 0.45e0 END"


O["soft_vote"] = f"""WITH t AS (SELECT device_id, seq, {_vote('confidence', 'anomaly_score')} AS p0, {_vote('anomaly_score', 'current / 20')} AS p1,
  {_vote('power / 5000', 'confidence')} AS p2 FROM ({PREDICTED})),
l AS (SELECT device_id, seq, unnest([0, 1, 2]) AS id, unnest([p0, p1, p2]) AS p FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY p DESC, id DESC) AS n, row_number() OVER (PARTITION BY seq ORDER BY p DESC, id) AS f
  FROM l WHERE p IS NOT NULL)
SELECT t.device_id, t.seq, coalesce(max(CASE WHEN f = 1 THEN id END), 0) AS fault_id, {r('coalesce(max(CASE WHEN n = 1 THEN p END), 1)')} AS confidence,
  coalesce(max(CASE WHEN n = 1 THEN {name_of('id')} END), '') AS first_name, {r('coalesce(max(CASE WHEN n = 2 THEN p END), 0)')} AS second_prob
FROM t LEFT JOIN k ON k.seq = t.seq GROUP BY t.device_id, t.seq"""
O["cost"] = f"SELECT device_id, seq, {r('power / 1000 * 6.5e0', 2)} AS cost FROM ({READINGS})"
O["duration_hms"] = f"""WITH t AS (SELECT device_id, seq, CAST(floor(power * 13) AS BIGINT) AS t FROM ({READINGS}))
SELECT device_id, seq, t // 3600 AS hours, t % 3600 // 60 AS minutes, t % 60 AS seconds,
  concat(t // 3600, 'h ', t % 3600 // 60, 'm') AS uptime FROM t"""

# Aggregates

SPREAD = ", ".join(f"{r(f'{f}({s})')} AS {s}_{f}" for s in SIGNALS for f in ("min", "avg", "max"))
O["signal_stats"] = f"SELECT device_id, count(*) AS samples, {SPREAD} FROM ({READINGS}) GROUP BY device_id"
O["recent_signal_stats"] = f"SELECT device_id, count(*) AS samples, {SPREAD} FROM ({newest(COARSE, 80)}) GROUP BY device_id"
O["peaks"] = peaks(READINGS)
STORED = f"SELECT * REPLACE (power * CASE WHEN device_id % 2 = 0 THEN 1.1e0 ELSE 0.9e0 END AS power) FROM ({READINGS})"
O["session_peak"] = f"""WITH a AS ({peaks(READINGS)}), b AS ({peaks(STORED)})
SELECT a.device_id, CASE WHEN {r('b.peak_power', 2)} > a.peak_power THEN {r('b.peak_power', 2)} ELSE a.peak_power END AS peak_power,
  CASE WHEN {r('b.peak_power', 2)} > a.peak_power THEN b.peak_power_time ELSE a.peak_power_time END AS peak_power_time
FROM a JOIN b USING (device_id)"""
O["running_energy"] = f"SELECT device_id, seq, {r('energy_kwh')} AS energy_kwh FROM ({metered(READINGS)})"
O["energy_report"] = f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY power DESC, ts, seq) AS pk,
  row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) AS age FROM ({parts(READINGS)})),
g AS (SELECT device_id, count(*) AS samples, sum(kwh) AS kwh, greatest(max(power), 0) AS peak_power,
  max(CASE WHEN pk = 1 AND power > 0 THEN ts END) AS peak_power_time, max(CASE WHEN age = 1 THEN power END) AS now FROM p GROUP BY 1)
SELECT device_id, samples, {r('kwh')} AS energy_kwh, {r('kwh * 6.5e0', 2)} AS cost, peak_power, peak_power_time,
  {STATUS4.format('now')} AS load_status FROM g"""
LOADS = {"idle": "power < 50", "light": "power >= 50 AND power < 500", "medium": "power >= 500 AND power < 1500", "heavy": "power >= 1500"}
O["load_profile"] = "SELECT device_id, " + ", ".join(
    f"CAST({r(f'count(*) FILTER (WHERE {w}) / count(*) * 100', 0)} AS INT) AS {n}_pct" for n, w in LOADS.items()
) + f" FROM ({READINGS}) GROUP BY device_id"
O["power_distribution"] = f"""WITH s AS (SELECT CAST(range AS INT) AS slot FROM range(12)), r AS ({READINGS}),
g AS (SELECT device_id, CAST(hour(ts) // 2 AS INT) AS slot, avg(power) AS p FROM r GROUP BY 1, 2), d AS (SELECT DISTINCT device_id FROM r)
SELECT device_id, slot, {r('coalesce(p, 0)', 0)} AS avg_power FROM d CROSS JOIN s LEFT JOIN g USING (device_id, slot)"""
O["energy_trend"] = f"""WITH g AS (SELECT device_id, CAST(ts AS DATE) AS d, max(energy_kwh) AS e FROM ({metered(READINGS)}) WHERE energy_kwh <> 0 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY d DESC) AS k FROM g)
SELECT device_id, CAST(d AS VARCHAR) AS day, {r('e')} AS energy_kwh FROM n WHERE k <= 7"""
O["energy_audit"] = f"""WITH s AS (SELECT *, CAST(ts AS DATE) AS d, CAST(max(ts) OVER (PARTITION BY device_id) AS DATE) AS l FROM ({parts(READINGS)})),
g AS (SELECT device_id, coalesce(sum(kwh) FILTER (WHERE d = l), 0) AS today, coalesce(sum(kwh) FILTER (WHERE date_trunc('week', d) = date_trunc('week', l)), 0) AS week,
  coalesce(sum(kwh) FILTER (WHERE date_trunc('month', d) = date_trunc('month', l)), 0) AS month, sum(kwh) AS total FROM s GROUP BY 1),
u AS (SELECT device_id, unnest(['today', 'week', 'month', 'total']) AS period, unnest([today, week, month, total]) AS k FROM g)
SELECT device_id, period, {r('k')} AS energy_kwh, {r('k * 6.5e0', 2)} AS cost FROM u"""
O["energy_audit_with_settings"] = f"""WITH s AS (SELECT *, kwh * rate AS spent, CAST(ts AS DATE) AS d, CAST(max(ts) OVER (PARTITION BY device_id) AS DATE) AS l FROM ({configured(parts(READINGS))})),
u AS (SELECT device_id, unnest(['today', 'week', 'month', 'total']) AS period, unnest([coalesce(sum(kwh) FILTER (WHERE d = l), 0),
  coalesce(sum(kwh) FILTER (WHERE date_trunc('week', d) = date_trunc('week', l)), 0), coalesce(sum(kwh) FILTER (WHERE date_trunc('month', d) = date_trunc('month', l)), 0), sum(kwh)]) AS k,
  unnest([coalesce(sum(spent) FILTER (WHERE d = l), 0), coalesce(sum(spent) FILTER (WHERE date_trunc('week', d) = date_trunc('week', l)), 0),
  coalesce(sum(spent) FILTER (WHERE date_trunc('month', d) = date_trunc('month', l)), 0), sum(spent)]) AS c FROM s GROUP BY device_id)
SELECT device_id, period, {r('k')} AS energy_kwh, {r('c', 2)} AS cost FROM u"""
O["energy_report_with_settings"] = f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY power DESC, ts, seq) AS pk,
  row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) AS age FROM ({configured(parts(READINGS))})),
g AS (SELECT device_id, count(*) AS samples, sum(kwh) AS kwh, sum(kwh * rate) AS spent, greatest(max(power), 0) AS peak_power,
  max(CASE WHEN pk = 1 AND power > 0 THEN ts END) AS peak_power_time,
  max(CASE WHEN age = 1 THEN CASE WHEN power > p_max THEN 'OVERLOAD!' WHEN power > p_max * 0.7e0 THEN 'HIGH LOAD' WHEN power > p_max * 0.3e0 THEN 'NORMAL' ELSE 'LIGHT' END END) AS load_status
FROM p GROUP BY 1)
SELECT device_id, samples, {r('kwh')} AS energy_kwh, {r('spent', 2)} AS cost, peak_power, peak_power_time, load_status FROM g"""
O["alert_summary"] = f"""WITH b AS ({PREDICTED_COARSE}), a AS ({LIMIT_ALERTS} UNION ALL {MODEL_ALERTS}),
l AS ({newest('SELECT * FROM a', 100, order='ts DESC, seq DESC, alert_no DESC')})
SELECT device_id, 'total' AS by, 'all' AS value, count(*) AS n FROM l GROUP BY 1
UNION ALL SELECT device_id, 'type', type, count(*) FROM l GROUP BY 1, 3
UNION ALL SELECT device_id, 'severity', severity, count(*) FROM l GROUP BY 1, 3"""
O["anomaly_rate"] = f"""SELECT device_id, {r(f'avg(CASE WHEN {ANOMALOUS} THEN 1e0 ELSE 0e0 END)')} AS anomaly_rate
FROM ({newest(PREDICTED_COARSE, 100)}) GROUP BY device_id"""
O["fault_distribution"] = f"""WITH g AS (SELECT device_id, {name_of('fault_id')} AS fault_name, count(*) AS n FROM ({newest(PREDICTED_COARSE, 100)}) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY n DESC, fault_name) AS INT) AS position FROM g"""


def recurring(base: str) -> str:
    return f"""SELECT device_id, fault_name, times FROM (
  SELECT device_id, {name_of('fault_id')} AS fault_name, count(*) AS times, sum(count(*)) OVER (PARTITION BY device_id) AS faults,
    row_number() OVER (PARTITION BY device_id ORDER BY count(*) DESC, {name_of('fault_id')}) AS k
  FROM ({newest(base, 30)}) WHERE fault_id <> 0 AND device_id IN (SELECT device_id FROM ({base}) GROUP BY 1 HAVING count(*) > 30)
  GROUP BY device_id, fault_id) WHERE k = 1 AND faults > 5"""


O["recurring_fault"] = recurring(PREDICTED)
O["label_distribution"] = f"""WITH s AS (SELECT CAST(range AS INT) AS label FROM range(10)), l AS ({labelled(READINGS)}),
g AS (SELECT s.label, count(l.seq) AS n FROM s LEFT JOIN l ON l.fault_label = s.label GROUP BY 1)
SELECT label, {name_of('label')} AS fault_name, n, {r('n * 100 / (SELECT count(*) FROM l)', 1)} AS percent FROM g"""
O["efficiency_report"] = f"{FACTS} SELECT {EFFICIENCY} FROM f"
USE, LOAD = "(ix / 15)", "(pm / 3000)"
PF0 = f"({PF.format('0e0')})"
COMPONENTS = {
    "voltage_stability": "CASE WHEN n > 10 THEN greatest(0, least(100, 100 - vs * 10 - abs(vm - 230) / 230 * 200)) ELSE 50e0 END",
    "current_safety": f"""CASE WHEN n <= 10 THEN 50e0 WHEN {USE} <= 0.7e0 THEN 100e0 WHEN {USE} <= 0.85e0 THEN 100 - ({USE} - 0.7e0) * 200
  WHEN {USE} <= 1 THEN greatest(0, 70 - ({USE} - 0.85e0) * 400) ELSE greatest(0, 10 - ({USE} - 1) * 100) END""",
    "power_efficiency": f"CASE WHEN n <= 10 THEN 50e0 WHEN {LOAD} < 0.8e0 THEN 100 - {LOAD} * 30 ELSE greatest(0, 100 - {LOAD} * 80) END",
    "anomaly_rate": "CASE WHEN scores > 10 THEN greatest(0, 100 - anomalous * 200) ELSE 80e0 END",
    "power_factor": f"""CASE WHEN n <= 10 THEN 50e0 WHEN {PF0} >= 0.95e0 THEN 100e0 WHEN {PF0} >= 0.85e0 THEN 80 + ({PF0} - 0.85e0) * 200
  WHEN {PF0} >= 0.7e0 THEN 40 + ({PF0} - 0.7e0) * 267 ELSE greatest(0, {PF0} * 57) END""",
    "energy_trend": """CASE WHEN n <= 60 THEN 70e0 WHEN abs(slope) < 1 THEN 90e0 WHEN slope < 0 THEN 95e0 ELSE greatest(0, 80 - slope * 5) END""",
}
O["health_components"] = f"SELECT device_id, {', '.join(f'{r(x)} AS {c}' for c, x in COMPONENTS.items())} FROM ({summary(PREDICTED, scored=True)})"
WEIGHTS = {"voltage_stability": 0.25, "current_safety": 0.2, "power_efficiency": 0.2, "anomaly_rate": 0.15, "power_factor": 0.1, "energy_trend": 0.1}
TOTAL = " + ".join(f"{c} * {w}e0" for c, w in WEIGHTS.items())
O["health_score"] = f"""WITH c AS (SELECT device_id, {', '.join(f'{x} AS {c}' for c, x in COMPONENTS.items())} FROM ({summary(PREDICTED_COARSE, scored=True)})),
t AS (SELECT *, {TOTAL} AS total FROM c)
SELECT device_id, {', '.join(f'{r(c)} AS {c}' for c in COMPONENTS)}, {r('total', 1)} AS overall_score, {health_label('total')} AS label,
  CASE WHEN total >= 90 THEN '#22c55e' WHEN total >= 75 THEN '#34d399' WHEN total >= 60 THEN '#eab308' WHEN total >= 40 THEN '#f97316' ELSE '#ef4444' END AS color
FROM t"""
O["cost_projection"] = f"""SELECT device_id, {r('kwh')} AS energy_kwh, {r('kwh * 6.5e0', 2)} AS cost, {r('kwh * 6.5e0 / hours')} AS hourly_cost,
  {r('kwh * 6.5e0 / hours * 24', 2)} AS daily_cost, {r('kwh * 6.5e0 / hours * 24 * 30', 2)} AS monthly_cost
FROM ({totals(READINGS)}) WHERE kwh > 0 AND hours > 0"""
O["latency_stats"] = f"""{STATS} SELECT device_id, total_inferences, {r('total_time_ms')} AS total_time_ms, {r('up')} AS session_uptime_s, error_count,
  {r('a')} AS avg_latency_ms, {r('lo')} AS min_latency_ms, {r('hi')} AS max_latency_ms, {r('p50')} AS p50_latency_ms, {r('p95')} AS p95_latency_ms,
  {r('p99')} AS p99_latency_ms, {r('sd')} AS std_latency_ms, {r('total_inferences / up')} AS throughput_ips FROM tot JOIN sp USING (device_id)"""
O["latency_by_model"] = f"""SELECT model, {r('avg(latency_ms)')} AS avg_ms,
  {r('CASE WHEN count(*) >= 20 THEN quantile_cont(latency_ms, 0.95) ELSE max(latency_ms) END')} AS p95_ms, count(*) AS count, 0e0 AS load_time_ms
FROM ({newest(LOG, 500, keys='model')}) GROUP BY model"""
AT = "list_sort(list(latency_ms))[CAST(floor(count(*) * {}e0) AS INT) + 1]"
O["latency_stats_floor"] = f"""WITH log AS ({LOG}), tot AS (SELECT device_id, count(*) AS total_inferences,
  count(*) / greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 1) AS rate FROM log GROUP BY 1),
sp AS (SELECT device_id, avg(latency_ms) AS a, min(latency_ms) AS lo, max(latency_ms) AS hi, stddev_pop(latency_ms) AS sd,
  {AT.format(0.5)} AS p50, {AT.format(0.95)} AS p95, {AT.format(0.99)} AS p99 FROM ({newest('SELECT * FROM log', 200)}) GROUP BY 1)
SELECT device_id, total_inferences, {r('rate')} AS throughput_ips, {r('a')} AS avg_ms, {r('p50')} AS p50_ms, {r('p95')} AS p95_ms, {r('p99')} AS p99_ms,
  {r('lo')} AS min_ms, {r('hi')} AS max_ms, {r('sd')} AS std_ms FROM tot JOIN sp USING (device_id)"""
CLASSES = f"""WITH p AS ({PREDICTED}), t AS (SELECT fault_label AS label, count(*) AS support, count(*) FILTER (WHERE fault_id = fault_label) AS hits FROM p GROUP BY 1),
q AS (SELECT fault_id AS label, count(*) AS predicted FROM p GROUP BY 1),
c AS (SELECT label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted FROM t FULL JOIN q USING (label)),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)"""
O["classification_metrics"] = f"""{CLASSES} SELECT {r('sum(hits) / sum(support)')} AS accuracy, {r('sum(pr * support) / sum(support)')} AS precision_weighted,
  {r('sum(re * support) / sum(support)')} AS recall_weighted, {r('sum(f1 * support) / sum(support)')} AS f1_weighted, CAST(sum(support) AS BIGINT) AS support FROM f"""
O["class_report"] = f"""{CLASSES} SELECT label, {name_of('label')} AS fault_name, {r('pr')} AS precision, {r('re')} AS recall, {r('f1')} AS f1, support FROM f"""
O["confusion_matrix"] = f"SELECT fault_label AS label, {', '.join(f'count(*) FILTER (WHERE fault_id = {k}) AS p{k}' for k in range(10))} FROM ({PREDICTED}) GROUP BY 1"


def _insight(no: int, category: str, title: str, severity: str, when: str) -> str:
    quoted = title if title.startswith("concat") else f"'{title}'"
    return f"SELECT device_id, {no} AS rule, '{category}' AS category, {quoted} AS title, '{severity}' AS severity FROM f WHERE samples >= 10 AND {when}"


FINE = "n > 20 AND vm <= 250 AND vm >= 200"
O["insights_list"] = f"""WITH f AS (SELECT * FROM ({summary(PREDICTED, scored=True)}) JOIN ({totals(PREDICTED)}) USING (device_id)
  LEFT JOIN ({recurring(PREDICTED)}) USING (device_id))
SELECT device_id, 0 AS rule, 'info' AS category, 'Collecting Data' AS title, 'info' AS severity FROM f WHERE samples < 10 UNION ALL """ + " UNION ALL ".join(
    [
        _insight(1, "voltage", "High Voltage Detected", "danger", "n > 20 AND vm > 250"),
        _insight(2, "voltage", "Low Voltage Alert", "danger", "n > 20 AND vm < 200"),
        _insight(3, "voltage", "Voltage Instability", "warning", f"{FINE} AND vs > 5"),
        _insight(4, "voltage", "Voltage Stable", "success", f"{FINE} AND vs <= 5"),
        _insight(5, "current", "Overcurrent Detected", "danger", "n > 20 AND ix > 15"),
        _insight(6, "current", "Current Near Limit", "warning", "n > 20 AND ix <= 15 AND ix > 15 * 0.85e0"),
        _insight(7, "power", "Power Overload!", "danger", "n > 20 AND px > 3000"),
        _insight(8, "power", "High Power Usage", "warning", "n > 20 AND px <= 3000 AND pm / 3000 * 100 > 70"),
        _insight(9, "power", "Normal Power Usage", "success", "n > 20 AND px <= 3000 AND pm / 3000 * 100 <= 70"),
        _insight(10, "efficiency", "Poor Power Factor", "warning", f"n > 20 AND {PF0} < 0.7e0"),
        _insight(11, "efficiency", "Moderate Power Factor", "info", f"n > 20 AND {PF0} >= 0.7e0 AND {PF0} < 0.85e0"),
        _insight(12, "anomaly", "Frequent Anomalies Detected", "warning", "scores > 50 AND anomalous > 0.1e0"),
        _insight(13, "fault", "concat('Recurring Fault: ', fault_name)", "warning", "fault_name IS NOT NULL"),
        _insight(14, "cost", "Energy Cost Analysis", "info", "kwh > 0 AND hours > 0"),
    ]
)
O["recommendations"] = f"""{FACTS}, {ADVICE} SELECT device_id, CAST(row_number() OVER (PARTITION BY device_id ORDER BY rank, rule) AS INT) AS position,
  CASE rank WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, title, category FROM a"""
O["active_alerts"] = f"WITH b AS ({newest(PREDICTED, 1)}) {LIMIT_ALERTS} UNION ALL {MODEL_ALERTS}"

# Windows


def _safe(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR NOT isfinite({x}) THEN 0 ELSE {x} END"


PAIRS = {"vi": ("voltage", "current"), "vp": ("voltage", "power"), "ip": ("current", "power")}


def windows(base: str) -> str:
    """Moments and rows of 30-row windows; features follow from these columns."""
    cols = []
    for s in SIGNALS:
        cols += [
            f"avg({s}) OVER w AS {s}_mean, stddev_pop({s}) OVER w AS {s}_sd, min({s}) OVER w AS {s}_lo, max({s}) OVER w AS {s}_hi",
            f"skewness({s}) OVER w AS {s}_sk, kurtosis_pop({s}) OVER w AS {s}_ku, quantile_cont({s}, 0.5) OVER w AS {s}_md",
            f"quantile_cont({s}, 0.25) OVER w AS {s}_q1, quantile_cont({s}, 0.75) OVER w AS {s}_q3, sqrt(avg({s} * {s}) OVER w) AS {s}_rms",
            f"regr_slope({s}, pos) OVER w AS {s}_slope, lag({s}, 29) OVER o AS {s}_l29, lag({s}, 15) OVER o AS {s}_l15, lag({s}, 14) OVER o AS {s}_l14",
        ]
    cols += [f"covar_pop({a}, {b}) OVER w AS cov_{n}" for n, (a, b) in PAIRS.items()]
    return f"""SELECT * FROM (SELECT *, {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS pos FROM ({base}))
WINDOW w AS (PARTITION BY device_id ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), o AS (PARTITION BY device_id ORDER BY pos))
WHERE pos >= 30"""


FEATURES: dict[str, str] = {}
for s in SIGNALS:
    flat = f"{s}_hi = {s}_lo"
    FEATURES |= {
        f"{s}_mean": f"{s}_mean",
        f"{s}_std": f"CASE WHEN {flat} THEN 0 ELSE {s}_sd END",
        f"{s}_min": f"{s}_lo",
        f"{s}_max": f"{s}_hi",
        f"{s}_range": f"{s}_hi - {s}_lo",
        f"{s}_skew": f"CASE WHEN {flat} THEN 0 ELSE {s}_sk * 28 / sqrt(870) END",
        f"{s}_kurtosis": f"CASE WHEN {flat} THEN 0 ELSE {s}_ku END",
        f"{s}_median": f"{s}_md",
        f"{s}_q25": f"{s}_q1",
        f"{s}_q75": f"{s}_q3",
        f"{s}_iqr": f"{s}_q3 - {s}_q1",
        f"{s}_rms": f"{s}_rms",
    }
for s in SIGNALS:
    FEATURES |= {
        f"{s}_trend_slope": f"{s}_slope",
        f"{s}_trend_intercept": f"{s}_mean - {s}_slope * 14.5e0",
        f"{s}_rate_of_change": f"{s} - {s}_mean",
        f"{s}_acceleration": f"({s} - {s}_l14) / 14 - ({s}_l15 - {s}_l29) / 14",
    }
STAT = [c for c in FEATURES if "_trend_" not in c and "_rate_of" not in c and "_accel" not in c]
TREND = [c for c in FEATURES if c not in STAT]
VI = "(voltage_mean * current_mean)"
DOMAIN = {
    "voltage_deviation_pct": "abs(voltage_mean - 230) / 230 * 100",
    "voltage_thd_estimate": "CASE WHEN voltage_mean > 0 THEN voltage_sd / voltage_mean * 100 ELSE 0 END",
    "current_load_pct": "current_mean / 15 * 100",
    "power_load_pct": "power_mean / 3000 * 100",
    "power_factor": f"CASE WHEN {VI} > 0 THEN power_mean / {VI} ELSE 0 END",
    "apparent_power": VI,
    "reactive_power": f"sqrt(greatest({VI} * {VI} - power_mean * power_mean, 0))",
    "voltage_crest_factor": "CASE WHEN voltage_rms > 0 THEN voltage_hi / voltage_rms ELSE 1 END",
    "current_crest_factor": "CASE WHEN current_rms > 0 THEN current_hi / current_rms ELSE 1 END",
    "energy_rate_wh_per_min": "power_mean / 60",
}
CROSS = {f"{n}_correlation": _safe(f"(cov_{n} / ({a}_sd * {b}_sd))") for n, (a, b) in PAIRS.items()} | {
    "power_voltage_ratio": "CASE WHEN voltage_mean > 0 THEN power_mean / voltage_mean ELSE 0 END",
    "power_current_ratio": "CASE WHEN current_mean > 0 THEN power_mean / current_mean ELSE 0 END",
}
STABLE = {f"{s}_stability_idx": f"1 - least(CASE WHEN {s}_mean > 0 THEN {s}_sd / {s}_mean ELSE 0 END, 1)" for s in SIGNALS} | {
    "is_voltage_in_range": "CASE WHEN voltage_mean BETWEEN 200 AND 250 THEN 1e0 ELSE 0e0 END",
    "is_current_safe": "CASE WHEN current_mean <= 15 THEN 1e0 ELSE 0e0 END",
    "is_power_safe": "CASE WHEN power_mean <= 3000 THEN 1e0 ELSE 0e0 END",
}
FEATURES |= DOMAIN | CROSS | STABLE


def _select(names, before: str = "device_id, seq") -> str:
    return f"SELECT {before}, {', '.join(f'{r(FEATURES[n])} AS {n}' for n in names)}"


O["stat_features"] = f"{_select(STAT)} FROM ({windows(READINGS)})"
O["trend_features"] = f"{_select(TREND)} FROM ({windows(READINGS)})"
O["domain_features"] = f"{_select(DOMAIN)} FROM ({windows(READINGS)})"
O["cross_features"] = f"{_select(CROSS)} FROM ({windows(READINGS)})"
O["stability_features"] = f"{_select(STABLE)} FROM ({windows(READINGS)})"
O["feature_vector"] = f"{_select(FEATURES)} FROM ({windows(READINGS)})"
SOME = ["voltage_mean", "current_q75", "power_skew", "power_trend_slope", "reactive_power", "ip_correlation", "power_stability_idx"]
O["sliding_features"] = f"{_select(SOME, 'device_id, seq, pos')} FROM ({windows(COARSE)})"
O["tumbling_features"] = f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS pos FROM ({labelled(READINGS)})),
v AS (SELECT device_id, (pos - 1) // 30 AS window_no, fault_label, count(*) AS c FROM l GROUP BY 1, 2, 3),
m AS (SELECT device_id, window_no, first(fault_label ORDER BY c DESC, fault_label) AS fault_label FROM v GROUP BY 1, 2)
{_select(FEATURES, 'device_id, window_no, m.fault_label')} FROM (SELECT *, pos // 30 - 1 AS window_no FROM ({windows(READINGS)}) WHERE pos % 30 = 0)
JOIN m USING (device_id, window_no)"""
O["align_labels"] = f"{_select(['power_mean'], 'device_id, seq, fault_label, CAST(fault_label AS DOUBLE) AS label')} FROM ({windows(labelled(READINGS))})"
O["rolling_series"] = f"""SELECT device_id, seq, count(*) OVER (PARTITION BY device_id) - age AS x, voltage, current, power FROM ({newest(COARSE, 80)})"""
AHEAD = "PARTITION BY device_id ORDER BY ts, seq"
O["frame_sequences"] = f"""WITH t AS (SELECT device_id, seq, power, lead(voltage, 59) OVER o AS last_voltage, sum(current) OVER (o ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS c,
  lead(power, 60) OVER o AS first_target, lead(power, 74) OVER o AS last_target FROM ({COARSE}) WINDOW o AS ({AHEAD}))
SELECT device_id, seq, 60 AS inputs, {r('power')} AS first_power, {r('last_voltage')} AS last_voltage, {r('c')} AS sum_current,
  {r('first_target')} AS first_target, {r('last_target')} AS last_target FROM t WHERE last_target IS NOT NULL"""
O["power_trend"] = f"""WITH t AS (SELECT device_id, count(*) AS n, regr_slope(power, -age) AS s, avg(power) FILTER (WHERE age <= 10) AS a
  FROM ({newest(COARSE, 120)}) GROUP BY 1)
SELECT device_id, CASE WHEN n < 10 THEN 'unknown' WHEN abs(s) < 0.5 THEN 'stable' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
  {r('CASE WHEN n < 10 THEN 0 ELSE s END')} AS slope, {r('CASE WHEN n >= 10 THEN a END')} AS current_avg,
  CASE WHEN n < 10 THEN 'Insufficient data' WHEN abs(s) < 0.5 THEN 'Power consumption is stable'
    ELSE concat('Power consumption ', CASE WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END, ' at ~', {text('abs(s)', 1)}, ' W/sample') END AS description FROM t"""
O["recent_latencies"] = f"""WITH t AS ({newest(LOG, 50)}), m AS (SELECT *, min(latency_ms) OVER d AS lo, max(latency_ms) OVER d AS hi, count(*) OVER d AS c
  FROM t WINDOW d AS (PARTITION BY device_id))
SELECT device_id, seq, c - age AS x, {r('latency_ms')} AS latency_ms, {r('(latency_ms - lo) / greatest(hi - lo, 0.001e0)')} AS scaled FROM m"""

# Fitting

O["train_stats"] = "SELECT device_id, " + ", ".join(
    f"{r(f'avg({s})')} AS {s}_mean, {r(f'stddev_pop({s})')} AS {s}_std" for s in SIGNALS
) + f" FROM ({READINGS}) GROUP BY device_id"
SCALED = {s: f"({s} - min({s}) OVER d) / coalesce(nullif(max({s}) OVER d - min({s}) OVER d, 0), 1)" for s in SIGNALS}
O["minmax_scale"] = f"""SELECT device_id, seq, {', '.join(f'{r(x)} AS {s}_scaled' for s, x in SCALED.items())}, {r('power')} AS restored
FROM ({READINGS}) WINDOW d AS (PARTITION BY device_id)"""
O["stratified_split"] = f"""WITH h AS (SELECT device_id, seq, fault_label, CAST(concat('0x', substr(md5(CAST(seq AS VARCHAR)), 1, 8)) AS BIGINT) AS h FROM ({labelled(READINGS)})),
n AS (SELECT *, row_number() OVER (PARTITION BY fault_label ORDER BY h, seq) AS k, count(*) OVER (PARTITION BY fault_label) AS c FROM h)
SELECT device_id, seq, fault_label, k <= floor(c * 0.2e0 + 0.5e0) AS is_test FROM n"""
O["chrono_split"] = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY device_id) AS c FROM ({READINGS}))
SELECT device_id, seq, k <= floor(c * 0.85e0) AS is_train FROM n"""


def fits(base: str) -> str:
    return f"""x AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) - 1 AS idx FROM ({base})),
f AS (SELECT device_id, count(*) AS n, coalesce(regr_slope(power, idx), 0) AS slope, coalesce(regr_intercept(power, idx), avg(power)) AS intercept,
  CASE WHEN count(*) > 100 THEN least(60, count(*) // 3) ELSE 0 END AS period FROM x GROUP BY 1),
s AS (SELECT device_id, idx % nullif(period, 0) AS phase, avg(power) AS season FROM x JOIN f USING (device_id) WHERE period > 0 AND idx < n // nullif(period, 0) * period GROUP BY 1, 2)"""


O["fit_trend"] = f"WITH {fits(COARSE)} SELECT device_id, n, {r('slope', 6)} AS slope, {r('intercept', 6)} AS intercept, period FROM f"
O["fit_seasonal"] = f"WITH {fits(COARSE)} SELECT device_id, phase, {r('season')} AS season FROM s"


def forecasts(origin: str) -> str:
    return f"""WITH {fits(COARSE)}, b AS (SELECT device_id, count(*) AS buffered, stddev_pop(power) FILTER (WHERE age <= 50) AS sd FROM ({newest(COARSE, 120)}) GROUP BY 1),
k AS (SELECT device_id, buffered, sd, slope, intercept, period, CAST(range AS INT) AS step, {origin} + range - 1 AS idx_at FROM b JOIN f USING (device_id) CROSS JOIN range(1, 16)),
p AS (SELECT k.*, CASE WHEN buffered < 3 THEN 0 ELSE greatest(0, CASE WHEN season IS NULL THEN slope * idx_at + intercept ELSE (slope * idx_at + intercept) * 0.6e0 + season * 0.4e0 END) END AS fc
  FROM k LEFT JOIN s ON s.device_id = k.device_id AND s.phase = k.idx_at % nullif(k.period, 0)),
i AS (SELECT *, sd * sqrt(step / 15) * 1.96e0 AS margin FROM p)"""


O["power_forecast"] = f"{forecasts('buffered')} SELECT device_id, step, {r('fc', 3)} AS forecast FROM i"
O["forecast_interval"] = f"""{forecasts('n')} SELECT device_id, step, {r('fc', 3)} AS forecast,
  {r('CASE WHEN buffered > 10 THEN greatest(fc - margin, 0) ELSE 0 END', 3)} AS lower, {r('CASE WHEN buffered > 10 THEN fc + margin ELSE 0 END', 3)} AS upper FROM i"""
O["extend_forecast"] = f"""{forecasts('buffered')}, l AS (SELECT device_id, fc, slope FROM i WHERE step = 15)
SELECT device_id, step, {r('fc', 3)} AS forecast FROM i
UNION ALL SELECT device_id, CAST(range + 15 AS INT), {r('fc + slope * range', 3)} FROM l CROSS JOIN range(1, 10)"""

SHOWN = ["voltage_mean", "voltage_std", "current_skew", "power_trend_slope", "is_power_safe"]
O["standardize"] = f"""WITH w AS (SELECT device_id, seq, {', '.join(f'{FEATURES[n]} AS {n}' for n in SHOWN)} FROM ({windows(READINGS)})),
m AS (SELECT {', '.join(f'avg({n}) AS m_{n}, coalesce(nullif(stddev_pop({n}), 0), 1) AS s_{n}' for n in SHOWN)} FROM w)
SELECT device_id, seq, {', '.join(f"{r(f'({n} - m_{n}) / s_{n}', 3)} AS {n}" for n in SHOWN)} FROM w CROSS JOIN m"""
O["append_and_read_log"] = f"""SELECT date_trunc('second', ts) AS timestamp, {r('voltage', 2)} AS voltage, {r('current', 3)} AS current, {r('power', 2)} AS power
FROM ({READINGS})"""
O["write_and_read_dataset"] = f"""SELECT date_trunc('millisecond', ts) AS timestamp, voltage, current, power, fault_label, {name_of('fault_label')} AS fault_name
FROM ({labelled(READINGS)})"""

# Streams

O["stream_readings"] = f"""SELECT seq, {r('voltage')} AS voltage, {r('current')} AS current, {r('voltage * current * 0.92e0')} AS power
FROM ({READINGS}) WHERE seq % 17 <> 0"""
O["stream_running_stats"] = f"""SELECT s.device_id, samples, {r('kwh')} AS energy_kwh, {', '.join(f'{s}_min, {s}_avg, {s}_max' for s in SIGNALS)},
  {', '.join(f'peak_{s}, peak_{s}_time' for s in SIGNALS)}
FROM ({ORACLES['signal_stats']}) s JOIN (SELECT device_id, kwh FROM ({totals(READINGS)})) USING (device_id) JOIN ({ORACLES['peaks']}) USING (device_id)"""
O["stream_features"] = O["feature_vector"]
O["stream_ewma"] = O["ewma_snap"]
O["stream_adc"] = O["adc_to_rms"]
O["stream_alerts"] = f"WITH b AS ({PREDICTED}) {LIMIT_ALERTS} UNION ALL {MODEL_ALERTS}"
O["stream_sessions"] = O["session_summary"]
O["stream_drop_repeated"] = O["drop_repeated"]
O["stream_live_table"] = f"""WITH m AS (SELECT * FROM ({metered(PREDICTED)}))
SELECT device_id, seq, ts AS timestamp, {r('voltage', 2)} AS voltage, {r('current', 3)} AS current, {r('power', 2)} AS power,
  {r('energy_kwh', 6)} AS energy_kwh, {name_of('fault_id')} AS fault_name, {ANOMALOUS} AS is_anomaly FROM ({newest('SELECT * FROM m', 1)})"""
O["stream_history_table"] = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS pos FROM ({READINGS}))
SELECT device_id, seq, ts AS timestamp, voltage, current, power FROM t WHERE pos % 5 = 0"""
O["stream_session_table"] = f"""SELECT device_id, min(ts) AS start_time, max(ts) AS end_time, samples AS sample_count, {r('any_value(kwh)')} AS energy_kwh,
  any_value(peak_power) AS peak_power_w, any_value(peak_power_time) AS peak_power_time
FROM ({READINGS}) JOIN (SELECT device_id, kwh, samples FROM ({totals(READINGS)})) USING (device_id) JOIN ({ORACLES['peaks']}) USING (device_id) GROUP BY device_id, samples"""


def tenth(base: str) -> str:
    """Rows up to the newest multiple of ten of each device."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq) AS pos, count(*) OVER (PARTITION BY device_id) AS c
FROM ({base})) WHERE pos <= c // 10 * 10"""


O["stream_health_table"] = f"""WITH b AS ({tenth(PREDICTED)}), c AS (SELECT device_id, n, {', '.join(f'{x} AS {c}' for c, x in COMPONENTS.items())}
  FROM ({summary('SELECT * FROM b', scored=True)})), t AS (SELECT device_id, n AS pos, {TOTAL} AS total FROM c)
SELECT device_id, pos, {r('total', 1)} AS overall_score, {health_label('total')} AS label FROM t"""
O["stream_recommendations"] = f"""WITH b AS ({tenth(READINGS)}), f AS (SELECT * FROM ({summary('SELECT * FROM b')}) JOIN ({totals('SELECT * FROM b')}) USING (device_id)),
{ADVICE} SELECT device_id, samples AS pos, CAST(row_number() OVER (PARTITION BY device_id ORDER BY rank, rule) AS INT) AS position,
  CASE rank WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, title FROM a JOIN f USING (device_id)"""

# Trees that are given as nodes, walked level by level

_NODES = ", ".join(
    f"({t}, {n}, {f}, {'NULL' if b == float('inf') else repr(b) + 'e0'}, {u}, {o}, {d!r}e0, {w})" for t, n, f, b, u, o, d, _, w in trees.nodes()
)


def walked(base: str) -> str:
    """Every reading's leaf in every tree."""
    signal = "CASE n.feature WHEN 0 THEN voltage WHEN 1 THEN current ELSE power END"
    steps = [f"n AS (SELECT * FROM (VALUES {_NODES}) AS v(tree, node, feature, border, below, above, length, weights))",
             f"w0 AS (SELECT b.*, tree, 0 AS node FROM ({base}) b, (SELECT DISTINCT tree FROM n))"]
    for k in range(trees.LEVELS):
        steps.append(
            f"w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN n.border IS NULL THEN w.node WHEN {signal} <= n.border THEN n.below ELSE n.above END AS node) FROM w{k} w JOIN n USING (tree, node))"
        )
    return "WITH " + ", ".join(steps) + f", leaves AS (SELECT w.*, length, weights FROM w{trees.LEVELS} w JOIN n USING (tree, node))"


DECIDED = f"""d AS (SELECT device_id, seq, -pow(2e0, -avg(length) / (2 * (ln(255e0) + 0.5772156649015329e0) - 2 * 255e0 / 256)) + 0.5e0 AS decision
FROM leaves GROUP BY device_id, seq)"""
O["forest_decisions"] = f"{walked(READINGS)}, {DECIDED} SELECT device_id, seq, {r('decision')} AS decision, decision < 0 AS is_outlier FROM d"
O["forest_metrics"] = f"""{walked(READINGS)}, {DECIDED} SELECT count(*) AS total_samples, count(*) FILTER (WHERE decision < 0) AS anomalies_found,
  {r('count(*) FILTER (WHERE decision < 0) / count(*)')} AS anomaly_rate, {r('avg(decision)')} AS score_mean, {r('stddev_pop(decision)')} AS score_std FROM d"""
O["forest_votes"] = f"""{walked(READINGS)},
f AS (SELECT device_id, seq, k AS id, sum(weights[k + 1] / list_sum(weights)) / {trees.TREES} AS p FROM leaves, (SELECT range AS k FROM range(10)) GROUP BY 1, 2, 3),
m AS (SELECT device_id, seq, [0, 3, 4, 7][tree % 4 + 1] AS id, sum((weights[1] - weights[2]) / 10e0) + 0.1e0 * [0, 3, 4, 7][tree % 4 + 1] AS z FROM leaves GROUP BY device_id, seq, tree % 4),
g AS (SELECT device_id, seq, id, exp(z) / sum(exp(z)) OVER (PARTITION BY device_id, seq) AS p FROM m),
v AS (SELECT f.device_id, f.seq, CAST(f.id AS INT) AS id, f.p * 0.55e0 + coalesce(g.p, 0) * 0.45e0 AS p FROM f LEFT JOIN g USING (device_id, seq, id)),
o AS (SELECT *, row_number() OVER (PARTITION BY device_id, seq ORDER BY p DESC, id) AS k FROM v)
SELECT device_id, seq, max(CASE WHEN k = 1 THEN id END) AS fault_id, {r('max(CASE WHEN k = 1 THEN p END)')} AS confidence,
  max(CASE WHEN k = 1 THEN {name_of('id')} END) AS first_name, {r('max(CASE WHEN k = 2 THEN p END)')} AS second_prob FROM o GROUP BY device_id, seq"""
