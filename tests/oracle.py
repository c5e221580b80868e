"""Side-by-side runs of registered queries and their SQL. ``python tests/oracle.py [sf] [names...]``"""

from __future__ import annotations

import importlib.util
import os
import sys
import time

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load_entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "ERROR")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _kind(kind: pa.DataType) -> pa.DataType:
    """A type without what the engines state differently: the unit of times, and the width of texts and of whole numbers."""
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us")
    if pa.types.is_integer(kind) or pa.types.is_decimal(kind) and kind.scale == 0:
        return pa.int64()
    return pa.string() if pa.types.is_large_string(kind) else kind


def _canonical(table: pa.Table) -> pa.Table:
    """Columns by name and rows in order."""
    names = sorted(table.column_names)
    table = pa.table({c: table[c].cast(_kind(table[c].type)) for c in names})
    return table.sort_by([(c, "ascending") for c in names]) if len(table) else table


def difference(found: pa.Table, expected: pa.Table) -> str | None:
    """What differs between the two results, or nothing; types are those of Arrow, where nulls do not change them."""
    if sorted(found.column_names) != sorted(expected.column_names):
        return f"columns {sorted(found.column_names)} vs {sorted(expected.column_names)}"
    if len(found) != len(expected):
        return f"rows {len(found)} vs {len(expected)}"
    a, b = _canonical(found), _canonical(expected)
    kinds = [(c, str(a[c].type), str(b[c].type)) for c in a.column_names if a[c].type != b[c].type]
    for c in a.column_names:
        x, y = a[c].to_pylist(), b[c].to_pylist()
        apart = [n for n, (v, w) in enumerate(zip(x, y, strict=True)) if v != w and not (v != v and w != w)]
        if apart:
            return f"{c}: {len(apart)} of {len(x)} differ, e.g. {x[apart[0]]!r} vs {y[apart[0]]!r} {kinds}"
    return f"types {kinds}" if kinds else None


def main() -> None:
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    entry, spark, con = load_entry(), session(), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start, found = time.time(), ()
        try:
            found = queries[name](spark, folder).toArrow()
            took = time.time() - start
            if name not in oracles:
                note = "rows only" if len(found) else "EMPTY"
            else:
                note = difference(found, con.execute(oracles[name]).to_arrow_table()) or "ok"
                if not len(found):
                    note += " EMPTY"
        except Exception as e:
            took, note = time.time() - start, f"{type(e).__name__}: {str(e)[:300]}"
        bad += note not in ("ok", "rows only")
        print(f"{name:28s} {took:6.2f}s {len(found):8d} {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    sys.path.insert(0, ROOT)
    main()
