"""Streams of readings: sources, event-time windows, alerts and the maintained tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridlens.config import DEFAULTS, KEYS, Settings
from gridlens.functions.scalar import health_label
from gridlens.operators.energy import merge_sessions, power_columns, session_parts
from gridlens.operators.insights import advise, device_summary, health_score
from gridlens.operators.records import alert_record, alerts, build_record, latest_reading, retain_last
from gridlens.operators.serving import latency_stats, perf_snapshot
from gridlens.session import scratch_path
from gridlens.sources.adc import adc_parts, merge_parts
from gridlens.sources.parse import drop_test_rows, parse_json_payload, parse_lines

BYTES_PER_TRIGGER = 64 << 20  # bounds the rows of a device in one micro-batch
OFFSETS_PER_TRIGGER = 1_000_000  # the same for Kafka, where options may set another number


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    fmt: str = "parquet",
    max_bytes: int = BYTES_PER_TRIGGER,
    **options: str,
) -> DataFrame:
    """New files of a folder (or pattern) as a stream. ``fmt="kafka"`` takes its options as given, and bounds a micro-batch."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.option("maxOffsetsPerTrigger", options.get("maxOffsetsPerTrigger", OFFSETS_PER_TRIGGER)).load()
    return reader.schema(schema).option("maxBytesPerTrigger", max_bytes).load(path)


def reading_stream(lines: DataFrame, kind: str = "csv", settings: Settings = DEFAULTS) -> DataFrame:
    """Raw lines or JSON messages (column ``value``) as readings, without test rows."""
    parsed = parse_lines(lines, settings=settings) if kind == "csv" else parse_json_payload(lines)
    return drop_test_rows(parsed) if "test_mode" in parsed.columns else parsed


def run_to_parts(
    stream: DataFrame, parts: dict[str, Callable[[DataFrame], DataFrame]], path: str | None = None, name: str = "parts"
) -> dict[str, DataFrame]:
    """Run a stream over all input there is; each of ``parts`` of every micro-batch goes to a folder of that name, all of which are read back.

    A folder per micro-batch lets a repeated one replace its own rows. Nothing is late: whatever comes is kept.
    With the same ``path``, a later run goes on where this one ended.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        for part, made in parts.items():
            made(batch).write.mode("overwrite").parquet(f"{path}/{part}/batch_id={batch_id}")

    store(spark.createDataFrame([], stream.schema), -1)  # gives every folder its schema
    started = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")
    started.trigger(availableNow=True).start().awaitTermination()
    return {part: spark.read.parquet(f"{path}/{part}").drop("batch_id") for part in parts}


def adc_stream(samples: DataFrame, window_ms: int = 200, path: str | None = None) -> DataFrame:
    """Voltage and current per device and window of all samples a stream has had, in whatever order they came."""
    return merge_parts(run_to_parts(samples, {"windows": lambda df: adc_parts(df, window_ms)}, path, "adc")["windows"])


def session_stream(readings: DataFrame, gap_minutes: float = 60, path: str | None = None) -> DataFrame:
    """Sessions of each device over all readings a stream has had, in whatever order they came."""
    parts = {"sessions": lambda df: session_parts(df, gap_minutes), "readings": power_columns}
    found = run_to_parts(readings, parts, path, "sessions")
    return merge_sessions(found["sessions"], found["readings"], gap_minutes)


def alert_stream(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Alerts of each reading as they come."""
    return alerts(scored, settings)


def run_to_table(stream: DataFrame, path: str | None = None, name: str = "stream") -> DataFrame:
    """Run a stream over all input there is, append its rows to a Parquet folder and read that."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


HISTORY = ("device_id", "seq", "ts", "voltage", "current", "power", "energy_kwh", "anomaly_score", "pos")


class Tables:
    """Tables kept up to date by a stream, as Parquet folders under ``root``.

    Each micro-batch writes its rows to a folder named after its id, so a repeated micro-batch
    replaces its own rows. Every ``compact_every`` micro-batches, each table is reduced to what
    it keeps and written as a new base; readers take the newest base and the batches after it. What the base
    before that held is deleted then, so a reader has ``compact_every`` micro-batches to end, and a table has at most
    twice as many folders.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        settings: Settings = DEFAULTS,
        history_every: int = 5,
        perf_every: int = 30,
        health_every: int = 10,
        keep: int = 500,
        health_history: int = 3600,
        compact_every: int = 100,
        perf_log: DataFrame | None = None,
    ):
        self.spark, self.root, self.settings, self.perf_log = spark, root.rstrip("/"), settings, perf_log
        self.history_every, self.perf_every, self.health_every = history_every, perf_every, health_every
        self.compact_every = compact_every
        self.reducers: dict[str, Callable[[DataFrame], DataFrame]] = {
            "live": lambda df: latest_reading(df, KEYS, ("timestamp", "seq")),
            "readings": lambda df: retain_last(df, keep, KEYS, ("timestamp", "seq")),
            "alerts": lambda df: df,
            "session": lambda df: latest_reading(df, KEYS, ("sample_count",)),
            "perf": lambda df: latest_reading(df, KEYS, ("timestamp", "total_inferences")),
            "history": lambda df: retain_last(df, health_history, KEYS),
            "health": lambda df: latest_reading(df, KEYS, ("pos",)),
            "recommendations": lambda df: df.join(
                df.groupBy("device_id").agg(F.max("pos").alias("pos")), ["device_id", "pos"], "left_semi"
            ),
        }

    def _load(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def read(self, name: str, upto_batch: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """The present rows of a table, or those as of a micro-batch; with ``only``, of the devices in it."""
        base, batches = self._load(f"{self.root}/{name}_base"), self._load(f"{self.root}/{name}")
        if upto_batch is not None:
            # A base of the same micro-batch may be left from an earlier try and is about to be replaced.
            base = None if base is None else base.filter(F.col("upto") < upto_batch)
            batches = None if batches is None else batches.filter(F.col("batch_id") <= upto_batch)
        upto = None if base is None else base.agg(F.max("upto")).first()[0]
        if upto is None:
            found = batches
        else:
            found = base.filter(F.col("upto") == upto).withColumnRenamed("upto", "batch_id")
            if batches is not None:
                found = found.unionByName(batches.filter(F.col("batch_id") > upto))
        if found is not None and only is not None:  # before anything is sorted
            found = found.join(only.select("device_id"), "device_id", "left_semi")
        return None if found is None else self.reducers[name](found.drop("batch_id"))

    def _write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def compact(self, batch_id: int) -> None:
        for name in self.reducers:
            rows = self.read(name, batch_id)
            if rows is not None:
                rows.write.mode("overwrite").parquet(f"{self.root}/{name}_base/upto={batch_id}")
                self.expire(name, batch_id - self.compact_every)

    def expire(self, name: str, upto: int) -> None:
        """Delete the batches of a table that a base of micro-batch ``upto`` or later holds, and bases before ``upto``."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        for folder, key in ((f"{self.root}/{name}", "batch_id"), (f"{self.root}/{name}_base", "upto")):
            fs = fs_path(folder).getFileSystem(conf)
            for status in fs.listStatus(fs_path(folder)) if fs.exists(fs_path(folder)) else []:
                label, _, number = status.getPath().getName().partition("=")
                old = number.isdigit() and (int(number) <= upto if key == "batch_id" else int(number) < upto)
                if label == key and old:
                    fs.delete(status.getPath(), True)

    def store(self, batch: DataFrame, batch_id: int) -> None:
        """Write one micro-batch of scored readings from ``running_stats``; runs once per micro-batch."""
        batch = batch.persist()
        labelled = batch.withColumns({"health_score": F.lit(100.0), "health_label": F.lit(None).cast("string")})
        known = self.read("health", batch_id - 1)
        if known is not None:
            health = known.select("device_id", F.col("overall_score").alias("_s"), F.col("label").alias("_l"))
            labelled = labelled.join(health, "device_id", "left").withColumns(
                {"health_score": F.coalesce("_s", "health_score"), "health_label": F.coalesce("_l", "health_label")}
            ).drop("_s", "_l")
        label = F.coalesce("health_label", health_label("health_score"))
        records = build_record(labelled.withColumn("health_label", label), extra=("pos",))
        self._write("live", batch_id, latest_reading(records, KEYS, ("timestamp", "seq")).drop("pos"))
        self._write("readings", batch_id, records.filter(F.col("pos") % self.history_every == 0).drop("pos"))
        self._write("alerts", batch_id, alert_record(batch))
        self._write("session", batch_id, _sessions(batch))
        self._write("history", batch_id, batch.select(*HISTORY))
        due = batch.filter(F.col("pos") % self.health_every == 0).groupBy("device_id").agg(F.max("pos").alias("pos"))
        self._health(batch_id, due)
        if self.perf_log is not None:
            calls = batch.filter(F.col("pos") % self.perf_every == 0).groupBy("device_id").agg(F.max("ts").alias("_until"))
            log = self.perf_log.join(calls, "device_id").filter(F.col("ts") <= F.col("_until")).drop("_until")
            self._write("perf", batch_id, perf_snapshot(latency_stats(log), log))
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)
        batch.unpersist()

    def _health(self, batch_id: int, due: DataFrame) -> None:
        """Health and recommendations as of each due device's newest multiple of ``health_every``."""
        history = self.read("history", batch_id, only=due)
        rows = history.join(due.withColumnRenamed("pos", "_due"), "device_id").filter(F.col("pos") <= F.col("_due"))
        facts = device_summary(rows.drop("_due"))
        self._write("health", batch_id, health_score(facts, self.settings).join(due, "device_id"))
        used = rows.groupBy("device_id").agg(F.max("energy_kwh").alias("energy_kwh"), F.max("pos").alias("samples"))
        advice = advise(facts.join(used, "device_id"), self.settings)
        self._write("recommendations", batch_id, advice.join(due, "device_id"))

    def start(self, scored: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            scored.writeStream.foreachBatch(self.store)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def _sessions(batch: DataFrame) -> DataFrame:
    """Session summary of each device as of its newest reading."""
    newest = latest_reading(batch, KEYS, ("pos",))
    peak = F.when(F.col("peak_power_us") >= 0, F.timestamp_micros("peak_power_us").cast("timestamp_ntz"))
    return newest.select(
        "device_id",
        F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_time"),
        F.col("ts").alias("end_time"),
        F.col("pos").alias("sample_count"),
        "energy_kwh",
        F.col("peak_power").alias("peak_power_w"),
        peak.alias("peak_power_time"),
    )
