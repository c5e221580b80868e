"""Document fingerprints by threshold-scaled sketches. DataFrame functions only.

A text's words (runs of other than white space, in lower case) give its set of shingles of
``WORDS`` words; a text of fewer words is one shingle. The sketch keeps every distinct shingle hash below
a fixed ``FRACTION`` of the hash range, so its size follows the text, sketches of parts merge by union, and
the share of a small sketch found in a large one estimates how much of the small text the large one contains.

Cases: a null text is an empty one; texts without words have no shingles; a short text may keep no
hash, so each fingerprint begins with a digest of the word sequence, and likeness is 1 where these agree,
and 0 where one sketch is empty and they do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.order import Numbered
from gridlens.session import materialize

WORDS, FRACTION = 5, 1 / 8


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside another function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of the shingles of a text, repeated ones included."""

    def hashes(tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - words + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, words), " ")))

    tokens = F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")
    return _let(tokens, lambda t: F.when(F.size(t) > 0, hashes(t)).otherwise(F.array().cast("array<bigint>")))


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes below the fraction, as numbers from 0 to 2^63."""
    limit = int(fraction * (1 << 63))
    kept = F.filter(F.transform(shingle_hashes(text, words), lambda h: F.shiftrightunsigned(h, 1)), lambda h: h < F.lit(limit))
    return F.array_sort(F.array_distinct(kept))


def digest(text: Column) -> Column:
    """Of the word sequence."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), "\\s+", " ")))


def fingerprint(digest: Column, sketch: Column) -> Column:
    """16 hexadecimal digits of the digest and of each hash."""
    hexadecimal = F.transform(F.concat(F.array(digest), sketch), lambda h: F.lpad(F.lower(F.hex(h)), 16, "0"))
    return F.array_join(hexadecimal, "")


def likeness(digest_a: Column, sketch_a: Column, digest_b: Column, sketch_b: Column) -> Column:
    """Share of the smaller sketch that the other one has: an estimate of containment."""
    least = F.least(F.size(sketch_a), F.size(sketch_b))
    share = F.size(F.array_intersect(sketch_a, sketch_b)) / least
    return F.when(digest_a == digest_b, 1.0).when(least == 0, 0.0).otherwise(share)


def merge(sketches: DataFrame, by: str, column: str = "sketch") -> DataFrame:
    """Sketches of the unions of documents with the same ``by``."""
    hashes = sketches.select(F.col(by).alias(by), F.explode(F.col(column)).alias("hash")).distinct()
    return hashes.groupBy(by).agg(F.array_sort(F.collect_list("hash")).alias(column))


def _successors(rows: DataFrame) -> DataFrame:
    """For each row (``row``, ``id``, ``n_chars``) the row that follows by descending id, and the first after the last.

    Rows are dealt into ranges by id; inside a range the next row follows by a window, and the last
    row of a range is followed by the first of the next one that has rows.
    """
    placed = materialize(rows.repartitionByRange(F.desc("id"), "row").withColumn("range", F.spark_partition_id()), "sketch-ranges")
    order = Window.partitionBy("range").orderBy(F.desc("id"), "row")
    ends = placed.groupBy("range").agg(F.min_by("row", F.struct(F.col("id").isNull(), -F.coalesce("id", F.lit(0)), "row")).alias("first"))
    ranges = Window.orderBy("range")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lead("first").over(ranges), F.first("first").over(whole)).alias("after"))
    followed = placed.withColumn("inside", F.lead("row").over(order)).join(ends, "range")
    return followed.select("row", F.coalesce("inside", "after").alias("next"), "n_chars")


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``digest`` and ``sketch`` of every text, without any shuffle."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(id).alias(id), F.col(text).alias("text"))
    return rows.select(id, F.length(whole).cast("long").alias("n_chars"), digest(whole).alias("digest"), sketch(whole).alias("sketch"))


def edited_fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness of its own to that and to the next document's.

    The edited text has its last ``n_chars // 2`` characters replaced by the first as many of the next
    document by descending id. Texts are shuffled once by row; the heads that replace something follow them.
    """
    rows = Numbered(df).select(id=F.col(id).cast("long"), text=F.coalesce(F.col(text), F.lit("")))
    next_rows = materialize(_successors(rows.select("row", "id", F.length("text").cast("long").alias("n_chars"))), "sketch-next")
    # both sides of the last join read this one shuffle of the texts
    ordered = rows.join(next_rows.select(F.col("row").alias("before"), F.col("next").alias("row"), F.col("n_chars").alias("n_before")), "row")
    heads = ordered.select(
        "before",
        F.col("id").alias("next_id"),
        F.substring("text", F.lit(1), F.floor(F.col("n_before") / 2).cast("int")).alias("head"),
        digest(F.col("text")).alias("next_digest"),
        sketch(F.col("text")).alias("next_sketch"),
    )
    n = F.length("text")
    joined = ordered.drop("before").join(heads, F.col("row") == F.col("before"))
    joined = joined.withColumns(
        {
            "digest": digest(F.col("text")),
            "sketch": sketch(F.col("text")),
            "edited": F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "head"),
        }
    )
    made = joined.withColumns({"edited_digest": digest(F.col("edited")), "edited_sketch": sketch(F.col("edited"))})
    own = F.col("digest"), F.col("sketch")
    return made.select(
        F.col("id").alias(id),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(*own).alias("fingerprint"),
        fingerprint(F.col("edited_digest"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(*own, F.col("edited_digest"), F.col("edited_sketch")).alias("near_edited"),
        likeness(*own, F.col("next_digest"), F.col("next_sketch")).alias("near_next"),
        F.col("next_id").alias(f"next_{id}"),
    )
