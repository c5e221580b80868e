"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast an object of this package; what is returned gives it to batch functions.

    It travels with its code, so executors need not have the package, and is unpacked once in a worker process.
    """
    return share_for_now(spark, value)[0]


def share_for_now(spark: SparkSession, value: Any) -> tuple[Callable[[], Any], Callable[[], None]]:
    """The same, and what deletes the object everywhere once nothing uses it any more. Arrays are not copied to be packed."""
    arrays: list = []
    packed = cloudpickle.dumps(value, protocol=5, buffer_callback=arrays.append)
    held = spark.sparkContext.broadcast((packed, arrays))

    def get() -> Any:
        if not hasattr(held, "unpacked"):
            code, buffers = held.value
            held.unpacked = cloudpickle.loads(code, buffers=buffers)
        return held.unpacked

    return get, held.destroy


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators count on.

    The group-limit threshold lets ``row_number() <= n`` keep only ``n`` rows per device in
    each map task, so that a busy device never reaches one reducer whole.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's, or a temporary one on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gridlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes shuffle files as soon as the statement that wrote them has ended.
CLEANED_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far; DataFrames built on them end to work."""
    while _written:
        delete(spark, _written.pop())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that was written and is used up."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which fixes its rows; what it shuffled is deleted once it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.append(path)
    before = spark.conf.get(CLEANED_UP)
    spark.conf.set(CLEANED_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = vars(table).pop("written_to", None) if table is not None else None
        if path in _written:
            _written.remove(path)
            delete(table.sparkSession, path)
