"""Importance resampling towards a target: array-scored weights, distributed quickselect.

Texts become runs of 1 to ``longest`` words, hashed into ``buckets``. The counts of all documents and of the target texts give an array with a
gain per bucket; a document's weight is the sum of the gains of its features, repeats counted. Adding a reproducible Gumbel draw per id makes
the highest scores a sample without replacement in proportion to exp(weight).

The highest k scores are found without a global sort. A row's key is (score, descending; id; features; a number that tells equal rows apart).
Each round takes ``PIVOTS`` rows of the open range at random, counts exactly how many rows lie before, on and after each of their keys, and narrows the range to the gap
between two pivots that holds the k-th key, until a pivot is that key. Only rows up to it are then sorted, by ranges, and ranked by the row counts of the ranges.

Cases: a null text has no features and weight 0; a null id draws as an empty text would, and comes after all other ids on ties; an empty
target or no documents are counts of 0; rows that repeat an id draw the same number; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.order import placed
from gridlens.llm.units import small_batches
from gridlens.session import materialize

BUCKETS, PIVOTS, ROWS_AT_ONCE = 10_000, 32, 256
#: Bytes of words: digits, letters (capitals lower-cased) and everything beyond ASCII; all others part words.
_WORDS = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class _Hashed(dict):
    """Buckets of words met before; the least room that keeps common words at hand."""

    def __init__(self, buckets: int, room: int = 500_000):
        super().__init__()
        self.buckets, self.room = buckets, room

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[feature] = found = crc32(feature) % self.buckets
        return found


def features(text: str | None, hashed: _Hashed, longest: int = 1) -> np.ndarray:
    """Bucket of every feature of a text, repeats included."""
    words = (text or "").encode().translate(_WORDS).split()
    found = [hashed[w] for w in words]
    for size in range(2, longest + 1):
        found += [hashed[b" ".join(words[k : k + size])] for k in range(len(words) - size + 1)]
    return np.array(found, dtype=np.int64)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features of all texts per bucket; tasks add up their own, Spark their sums, and ``buckets`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = _Hashed(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in small_batches(batch, ROWS_AT_ONCE):
                found = [features(t, hashed, longest) for t in part.column(0).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares in the target and in the source, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def draw(id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel number that depends on the id alone, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share))).cast("long")


def weighted(df: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """``id``, ``n_features`` and ``weight`` of every row."""
    kind = df.schema[id].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed(len(gain))
        for batch in batches:
            for part in small_batches(batch, ROWS_AT_ONCE):
                found = [features(t, hashed, longest) for t in part.column(1).to_pylist()]
                sums = [int(gain[f].sum()) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(sums, pa.int64())], ["id", "n_features", "weight"])

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(score, f"id {kind}, n_features long, weight long")


#: Parts of a row's key, in order: the highest score first, then the smallest id.
KEY = ("down", "last", "id", "n_features", "row")


def _key(row: dict | None = None, kind: str = "") -> Column:
    """The key of every row, or of one that is known; keys compare part by part."""
    return F.struct(*KEY) if row is None else F.struct(*[F.lit(row[part]).alias(part) for part in KEY]).cast(kind)


def kth(rows: DataFrame, k: int, seed: int) -> Column | None:
    """The k-th key of ``rows`` (from 1), or nothing if there are fewer.

    ``PIVOTS`` keys come to the driver in each round, and as many counts. Keys are unique, so every round leaves a smaller range; the
    expected number of rounds is about log(rows) / log(PIVOTS).
    """
    kind = rows.select(_key().alias("key")).schema["key"].dataType.simpleString()
    low = high = None
    passed = 0  # rows up to and with ``low``
    while True:
        between = rows
        if low is not None:
            between = between.where(_key() > low)
        if high is not None:
            between = between.where(_key() < high)
        drawn = between.select(*KEY, F.xxhash64("row", F.lit(seed + passed)).alias("chance")).orderBy("chance", "row").limit(PIVOTS).collect()
        if not drawn:
            return None
        drawn.sort(key=lambda r: tuple((r[part] is not None, 0 if r[part] is None else r[part]) for part in KEY))
        pivots = [_key(r.asDict(), kind) for r in drawn]
        # Pivots up to a row's key: what shares a number lies between the same two, the lower one with it.
        part = F.size(F.filter(F.array(*pivots), lambda pivot: pivot <= F.col("key")))
        counts = dict(between.select(_key().alias("key")).groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())
        if passed + sum(counts.values()) < k:
            return None
        for n, pivot in enumerate(pivots):
            upto = passed + counts.get(n, 0)
            if upto + 1 == k:  # k - 1 rows before it and one equal to it
                return pivot
            if upto >= k:
                high = pivot
                break
            # The pivot itself is one of the rows counted with the next part.
            low, passed, counts[n + 1] = pivot, upto + 1, counts[n + 1] - 1


def resample(
    docs: DataFrame, target: DataFrame, percent: int, id: str = "doc_id", text: str = "text", target_text: str = "text", least: int = 20, buckets: int = BUCKETS, longest: int = 1, seed: int = 2024
) -> DataFrame:
    """Every row's ``id``, ``n_features``, ``weight``, ``score`` and, for those drawn, ``rank``.

    Of the rows with at least ``least`` features, ``percent`` in a hundred are drawn.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    scored = weighted(docs, gain, id, text, longest).withColumn("score", F.col("weight") + draw(F.col("id"), seed))
    scored = materialize(scored.withColumns({"down": -F.col("score"), "last": F.col("id").isNull(), "row": F.monotonically_increasing_id()}), "scored")
    eligible = scored.where(F.col("n_features") >= least)
    k = percent * eligible.count() // 100
    edge = kth(eligible, k, seed) if k else None
    drawn = F.lit(False) if edge is None else (F.col("n_features") >= least) & (_key() <= edge)
    winners = placed(scored.where(drawn).withColumn("one", F.lit(0)), KEY, "one", "winners")
    out = [F.col("id").alias(id), "n_features", "weight", "score"]
    return winners.select(*out, (F.col("place") + 1).alias("rank")).unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
