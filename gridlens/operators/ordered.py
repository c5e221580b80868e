"""Row order inside a device, without sorting a busy device in one task.

``ordered`` numbers the rows of each device and hands out window specs for row frames. It first
counts rows per device, unless the whole input is small. While the largest device fits in one task, the device is the window
partition. Beyond that, the rows are range-partitioned by (device, time), which splits any
device evenly, their positions follow from per-partition counts, and every window partition is
a chunk of fixed size that carries copies of the few neighbouring rows a frame looks at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.config import KEYS, ORDER
from gridlens.session import materialize

GROUP_LIMIT = 4_000_000  # rows of one device that one task may sort
CHUNK = 65_536  # rows of one chunk of a busier device
SMALL_BYTES = 32 << 20  # an input this small fits in one task, so that its groups need no count
ROW_BYTES = 16  # of a reading in a file, to estimate rows from bytes
TASK_ROWS = 4_000_000  # rows per shuffle partition at scale
TASK_CEILING = 200_000  # shuffle partitions a driver can keep track of
PRECISION = 1_000  # of the quantiles of a large group's times; their error is a part in so many of its rows
TAILS = 20  # halvings of a group that the quantiles tell
CUT_ROUNDS = 3
TASK_FLOOR = 8_192  # below this, a further task costs more than it saves


@dataclass(frozen=True)
class Series:
    """Numbered rows (column ``pos``, from 1) and the windows that run over them."""

    df: DataFrame
    keys: tuple[str, ...]
    part: tuple[str, ...]
    order: tuple[str, ...]
    total: int

    @property
    def split(self) -> bool:
        return len(self.part) > len(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.window().rowsBetween(start, end)

    def own(self, df: DataFrame) -> DataFrame:
        """Drop the copied neighbour rows and the helper columns."""
        return df.filter("_own").drop("_own", "_chunk") if self.split else df

    def sorted(self) -> DataFrame:
        """The rows of each window partition together and in order, for batch functions."""
        df = self.df
        if self.split:
            df = df.repartition(task_count(df, self.total), *self.part)
        return df.sortWithinPartitions(*self.part, *self.order)


def task_count(df: DataFrame, rows: int) -> int:
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(ceil(rows / TASK_ROWS), TASK_CEILING), min(default, ceil(rows / TASK_FLOOR)), 1)


def input_bytes(df: DataFrame) -> int | None:
    """Spark's estimate of the size of ``df`` from the files it reads."""
    plan = getattr(df, "_jdf", None)
    return None if plan is None else int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def group_sizes(df: DataFrame, keys: Sequence[str], exact: bool = False) -> tuple[int, int]:
    """(all rows, rows of the largest group), or upper estimates where the whole input is small."""
    size = None if exact else input_bytes(df)
    if size is not None and size <= SMALL_BYTES:
        rows = size // ROW_BYTES + 1
        return rows, min(rows, GROUP_LIMIT)
    per_group = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = per_group.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    return row["total"] or 0, row["largest"] or 0


def ordered(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    behind: int = 0,
    ahead: int = 0,
    limit: int | None = None,
    chunk: int | None = None,
    sizes: bool = False,
) -> Series:
    """Number the rows of each group; frames may look ``behind`` and ``ahead`` that many rows.

    With ``sizes``, ``_n`` has the rows of the group next to each of them.
    """
    keys, order = tuple(keys), tuple(order)
    total, largest = group_sizes(df, keys, exact=limit is not None)
    limit = limit or GROUP_LIMIT
    if largest <= limit:
        spread = df.repartition(task_count(df, total), *keys)
        numbered = spread.withColumn(
            "pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
        )
        if sizes:
            numbered = numbered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return Series(numbered, keys, keys, order, total)
    return _in_chunks(_positions(df, keys, order, total, sizes), keys, behind, ahead, chunk or CHUNK, total)


def _positions(df: DataFrame, keys: tuple, order: tuple, total: int, sizes: bool) -> DataFrame:
    tasks = task_count(df, total)
    laid_out = materialize(
        df.repartitionByRange(tasks, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_slice", F.shiftright("_at", 33))
    runs = laid_out.groupBy(*keys, "_slice").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = [F.sum("_n").over(Window.partitionBy(*keys)).alias("_n")] if sizes else []
    starts = runs.select(
        *keys, "_slice", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), *all_rows
    )
    return (
        laid_out.join(starts, [*keys, "_slice"])
        .withColumn("pos", F.col("_at") + F.col("_shift") + 1)
        .drop("_at", "_slice", "_shift")
    )


def _in_chunks(
    df: DataFrame, keys: tuple, behind: int, ahead: int, size: int, total: int
) -> Series:
    if max(behind, ahead) > size:
        raise ValueError("a frame may not reach past the neighbouring chunk")
    home = F.floor((F.col("pos") - 1) / F.lit(size))
    at = F.pmod(F.col("pos") - 1, F.lit(size))
    copies = F.filter(
        F.array(
            F.struct(home.alias("_chunk"), F.lit(True).alias("_own")),
            F.when(at >= size - behind, F.struct((home + 1).alias("_chunk"), F.lit(False).alias("_own"))),
            F.when(
                (at < ahead) & (home > 0),
                F.struct((home - 1).alias("_chunk"), F.lit(False).alias("_own")),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    spread = df.select("*", F.inline(copies))
    return Series(spread, keys, (*keys, "_chunk"), ("pos",), total)


def running_sums(series: Series, df: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Cumulative sums over each group of ``series``; ``df`` holds its rows with more columns.

    Chunks are summed on their own and shifted by the totals of the chunks before them.
    """
    upto = series.rows(Window.unboundedPreceding, Window.currentRow)
    if not series.split:
        return df.withColumns({name: F.sum(x).over(upto) for name, x in sums.items()})
    own = df.filter("_own")
    local = own.withColumns({name: F.sum(x).over(upto) for name, x in sums.items()})
    per_chunk = own.groupBy(*series.part).agg(
        *[F.sum(x).alias(f"_sum_{name}") for name, x in sums.items()]
    )
    earlier = Window.partitionBy(*series.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.select(
        *series.part, *[F.sum(f"_sum_{name}").over(earlier).alias(f"_before_{name}") for name in sums]
    )
    joined = local.join(before, list(series.part))
    return joined.withColumns(
        {name: F.col(name) + F.coalesce(F.col(f"_before_{name}"), F.lit(0)) for name in sums}
    ).drop(*[f"_before_{name}" for name in sums])


def _times(column: str, df: DataFrame) -> Column | None:
    """A column to order by as a number, if it has one."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column) if isinstance(kind, T.NumericType) else None


def recent_part(df: DataFrame, n: int, keys: Sequence[str], first: str, limit: int) -> DataFrame:
    """Without most of the older rows of groups of more than ``limit`` rows; their newest ``n`` by ``first`` all stay.

    Groups of that size are few, at most rows / ``limit``, so what is known of them can be broadcast. Mergeable quantile summaries, halving the tail from step to step, give each
    a time after which there are at least ``n`` rows whatever the summaries' error, and seldom more than twice that and the error. One round leaves
    about a part in ``PRECISION`` / 4 of a group, so a second one is needed for the very largest only.
    """
    t = _times(first, df)
    if t is None:
        return df
    tails = F.array(*[F.lit(1 - 2.0**-k) for k in range(1, TAILS + 1)])
    for _ in range(CUT_ROUNDS):
        sizes = df.groupBy(*keys).agg(F.count(t).alias("_size")).filter(F.col("_size") > limit)
        heavy = materialize(sizes, "large-groups")
        least = F.lit(n) + F.ceil(F.col("_size") * 2 / PRECISION) + 1
        step = F.floor(F.log2(F.col("_size") / least)).cast("int")
        found = df.join(F.broadcast(heavy), list(keys)).groupBy(*keys, "_size").agg(F.percentile_approx(t, tails, F.lit(PRECISION)).alias("_tails"))
        cutoffs = found.filter(step >= 1).select(*keys, F.element_at("_tails", F.least(step, F.lit(TAILS))).alias("_cutoff"))
        cutoffs = materialize(cutoffs, "cutoffs")
        if cutoffs.isEmpty():
            break
        df = df.join(F.broadcast(cutoffs), list(keys), "left").filter(F.col("_cutoff").isNull() | (t >= F.col("_cutoff"))).drop("_cutoff")
    return df


def latest(
    df: DataFrame,
    n: int,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    limit: int | None = None,
) -> DataFrame:
    """The newest ``n`` rows of each group, with ``age`` 1 for the newest.

    Groups of more than ``limit`` rows first lose what is older than a time that their newest
    ``n`` rows are known to lie after, so that no reducer sees many more than ``limit`` rows of a group,
    whatever Spark's own limit on ranks in map tasks is set to.
    """
    _, largest = group_sizes(df, keys, exact=limit is not None)
    newest = [F.col(c).desc() for c in order]

    def cut(rows: DataFrame, *part: str) -> DataFrame:
        age = F.row_number().over(Window.partitionBy(*part).orderBy(*newest))
        return rows.withColumn("age", age.cast("long")).filter(F.col("age") <= n)

    if largest > (limit or GROUP_LIMIT):
        df = recent_part(df, n, keys, order[0], limit or GROUP_LIMIT)
    return cut(df, *keys)
