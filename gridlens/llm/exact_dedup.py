"""Exact duplicates with a heavy-hitter split.

Texts are equal when they are identical after every run of ASCII white space became one space; a null
text counts as empty. The SHA-256 of that form stands for the text. Digests that many rows share are found by
Misra-Gries summaries of ``counters`` entries: each task keeps one, and their sums miss a digest's rows by at most
rows / (counters + 1) altogether. Digests whose sum exceeds that are candidates, fewer than ``counters + 1`` whatever the table. A
second pass counts them exactly and finds their winners, which are broadcast, so that their rows are decided where they are read.
All other digests have at most twice that many rows, and go through an ordinary shuffle.

Of equal texts the row with the smallest id stays; a null id is larger than any other.

Cases: null and empty texts are one group with each other, texts of nothing but white space another; of rows that repeat both id
and text exactly one stays; an empty table gives an empty result; columns of ``df`` other than the id, the text and those in ``carried``
are ignored, whatever their names, and those in ``carried`` come back in the struct ``carried``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import materialize

COUNTERS = 1_024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Summary:
    """A Misra-Gries summary: at most ``counters`` keys, with counts that are too small by at most rows / (counters + 1)."""

    def __init__(self, counters: int):
        self.counters = counters
        self.counts: dict[bytes, int] = {}

    def add(self, keys: list[bytes], counts: list[int]) -> None:
        kept = self.counts
        for key, n in zip(keys, counts, strict=True):
            kept[key] = kept.get(key, 0) + n
        if len(kept) > self.counters:
            # Each unit taken off here is taken off counters + 1 different keys.
            off = sorted(kept.values(), reverse=True)[self.counters]
            self.counts = {key: n - off for key, n in kept.items() if n > off}


def frequent(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Values of a binary column that may be in more than 2 / (``counters`` + 1) of the rows: all that are, fewer than ``counters`` + 1 in all."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters)
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            summary.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(summary.counts), pa.binary()), pa.array(list(summary.counts.values()), pa.int64())], ["value", "n"])

    rows = df.count()
    summaries = df.select(column).mapInArrow(summarise, "value binary, n long")
    least = max(rows // (counters + 1), 1)  # a value of one row is nobody's copy
    return summaries.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") > least).select(F.col("value").alias(column))


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", carried: Sequence[str] = (), counters: int = COUNTERS) -> DataFrame:
    """Every row's ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``carried``."""
    columns = [F.col(id).alias("id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest")]
    rest = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None).cast("string")
    rows = materialize(df.select(*columns, rest.alias("carried"), F.monotonically_increasing_id().alias("row")), "digests")
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    found = [F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size")]
    keys = rows.select("id", "digest", "row")
    # Fewer than counters + 1 rows of 32 bytes, and as many winners.
    winners = materialize(keys.join(F.broadcast(frequent(rows, "digest", counters)), "digest").groupBy("digest").agg(*found), "winners")
    heavy = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rare = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rare = rare.withColumns({"first": F.min(place).over(group), "group_size": F.count(F.lit(1)).over(group)})
    return heavy.unionByName(rare).select(
        F.col("id").alias(id),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["carried"] if carried else []),
    )


def first_rows(df: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    return dedup(df, id, text, df.columns, counters).where("kept").select("carried.*")
