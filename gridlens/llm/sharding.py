"""Sharding by minimax contiguous partition. DataFrame functions only.

Groups of rows that must stay together (equal texts, say) are put in the order of their key, and
that order is cut into ``shards`` runs so that the largest run is as small as it can be. The
smallest feasible capacity is found by binary search; a capacity is feasible if filling shards
greedily in order takes no more shards than there are.

The search never sees the groups themselves. It works on blocks, i.e. key ranges with their total,
their number of groups and their largest group, which Spark adds up. For a block it is known that
a greedy cut inside it falls within one largest group of the point where the capacity runs out, so
each cut has a lower and an upper bound. Blocks in which a cut may lie are split further, and the
search ends when every cut is known to the byte. The driver holds a bounded number of blocks.

A group larger than the mean of what is left over gets a shard of its own, because no cut could
even it out; the others are partitioned among the remaining shards.

Cases: an empty table has no rows; null and empty values of the group column are two groups; equal
values share a shard whatever their number; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import materialize

#: Hexadecimal digits of a group key; the digits of the first blocks, and those that each split adds.
KEY_DIGITS, FIRST_DIGITS, MORE_DIGITS = 32, 4, 2
#: Rows that are numbered together within a shard, and the least number of such buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 256


def group_key(column: str | Column) -> Column:
    """128 bits of SHA-256 as hexadecimal digits; null has a key below all others."""
    return F.coalesce(F.substring(F.sha2(F.col(column) if isinstance(column, str) else column, 256), 1, KEY_DIGITS), F.lit(""))


@dataclass
class Block:
    prefix: str
    total: int
    groups: int
    largest: int


@dataclass
class Cuts:
    """``starts``: first key of every shard but the first; ``own``: keys with a shard of their own, which come last."""

    starts: list[str]
    own: list[str]
    capacity: int
    shards: int

    def shard(self, key: Column) -> Column:
        run = F.lit(0)
        for start in self.starts:
            run = run + (key >= F.lit(start)).cast("int")
        alone = F.lit(None).cast("int")
        for n, own in enumerate(self.own):
            alone = F.when(key == F.lit(own), F.lit(self.shards - len(self.own) + n)).otherwise(alone)
        return F.coalesce(alone, run) if self.own else run


def _blocks(groups: DataFrame, digits: int, within: dict[str, int] | None = None) -> list[Block]:
    """Totals by the first ``digits`` of the key; ``within`` are the prefixes to split."""
    if within is not None:
        length = next(iter(within.values()))
        wanted = groups.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in within])).alias("wanted"))
        groups = groups.join(wanted, F.substring("key", 1, length) == F.col("wanted"), "left_semi")
    found = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
        F.sum("size").alias("total"), F.count("*").alias("groups"), F.max("size").alias("largest")
    )
    return [Block(r.prefix, int(r.total), r.groups, int(r.largest)) for r in found.collect()]


def _cut_bounds(blocks: list[Block], capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Lower and upper bounds of the greedy cuts, as sums of the sizes before them."""
    low, high, at_low, at_high = [0], [0], 0, 0
    before = [0]
    for b in blocks:
        before.append(before[-1] + b.total)
    total = before[-1]

    def reach(start: int, i: int, sure: bool) -> tuple[int, int]:
        end = start + capacity
        if end >= total:
            return total, len(blocks)
        while before[i + 1] <= end:
            i += 1
        if blocks[i].groups == 1:
            return before[i], i
        return (max(before[i], end - blocks[i].largest + 1) if sure else end), i

    for _ in range(shards):
        position, at_low = reach(low[-1], at_low, True)
        low.append(max(position, low[-1]))
        position, at_high = reach(high[-1], at_high, False)
        high.append(max(position, high[-1]))
    return low, high


def minimax_cuts(groups: DataFrame, shards: int) -> Cuts:
    """Cuts for a table of groups (``key`` hexadecimal, ``size`` above 0)."""
    top = [(r.key, int(r["size"])) for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect()]
    total = int(groups.agg(F.sum("size")).first()[0] or 0)
    own: list[str] = []
    for key, size in top:
        if len(own) < shards - 1 and size * (shards - len(own)) > total and total > size:
            own.append(key)
            total -= size
        else:
            break
    rest, runs = (groups.where(~F.col("key").isin(own)) if own else groups), shards - len(own)
    if not total:
        return Cuts([], own, 0, shards)

    digits, blocks = FIRST_DIGITS, _blocks(rest, FIRST_DIGITS)
    while True:
        blocks.sort(key=lambda b: b.prefix)
        largest = max(b.largest for b in blocks)
        lo, hi = max(-(-total // runs), largest), -(-total // runs) + largest
        first, last = lo, hi
        while lo < hi:  # the smallest capacity that is feasible for certain
            middle = (lo + hi) // 2
            lo, hi = (lo, middle) if _cut_bounds(blocks, middle, runs)[0][-1] >= total else (middle + 1, hi)
        sure = lo
        lo, hi = first, min(last, sure)
        while lo < hi:  # the smallest that is not ruled out
            middle = (lo + hi) // 2
            lo, hi = (lo, middle) if _cut_bounds(blocks, middle, runs)[1][-1] >= total else (middle + 1, hi)
        earliest, latest = _cut_bounds(blocks, lo, runs)[0], _cut_bounds(blocks, sure, runs)[1]
        open_blocks, before, cut = {}, 0, 1
        spans = sorted(zip(earliest[1:], latest[1:], strict=True))
        for b in blocks:
            after = before + b.total
            while cut <= len(spans) and spans[cut - 1][1] <= before:
                cut += 1
            if b.groups > 1 and cut <= len(spans) and any(s < after and e > before and s < total for s, e in spans[cut - 1 :]):
                open_blocks[b.prefix] = min(digits, KEY_DIGITS)
            before = after
        if not open_blocks:
            break
        digits = min(KEY_DIGITS, digits + MORE_DIGITS)
        done = [b for b in blocks if b.prefix not in open_blocks]
        blocks = done + _blocks(rest, digits, open_blocks)

    starts, fill = [], 0
    for b in blocks:
        if fill and fill + b.total > sure:
            starts.append(b.prefix)
            fill = 0
        fill = (fill + b.total - 1) % sure + 1 if b.total > sure else fill + b.total
    return Cuts(starts, own, sure, shards)


def shard_rows(df: DataFrame, shards: int, id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Every row with its shard, its gapless slot there and its size in bytes (UTF-8 plus ``overhead``).

    Columns: ``id``, ``size``, ``text_crc32`` (null for null text), ``shard``, ``slot``. Texts are
    read once; what follows works on a narrow table. Slots are numbered by buckets of rows of a
    shard, whose counts are added up first, so no task holds a whole shard.
    """
    rows = materialize(
        df.select(
            F.col(id).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.col(text)).alias("text_crc32"),
            group_key(text).alias("key"),
            F.spark_partition_id().alias("part"),
        ),
        "sharding",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "sharding-groups")
    cuts = minimax_cuts(groups, shards)
    buckets = max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS)
    placed = rows.withColumns(
        {"shard": cuts.shard(F.col("key")), "bucket": F.pmod(F.xxhash64("id", "part"), F.lit(buckets)).cast("int")}
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(starts, ["shard", "bucket"])
        .select(F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))
    )
