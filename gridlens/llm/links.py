"""What the similarity operators share: exact checks of pairs on full sets, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.words import jaccard_counts
from gridlens.session import materialize

#: Bits of the filter that tells which nodes occur in pairs (2 MB); where it fills up, more sets are shuffled, none is missed.
FILTER_BITS = 1 << 24


def node_filter(pairs: DataFrame) -> bytes:
    """A filter of fixed size over the nodes of ``pairs`` (``a``, ``b``)."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    place = F.pmod(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long"), F.lit(FILTER_BITS))
    return place_filter(nodes.select(place.alias("place")))


def place_filter(places: DataFrame) -> bytes:
    """A filter of fixed size over ``place``, from 0 to below ``FILTER_BITS``."""
    bits = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    whole = bytearray(FILTER_BITS // 8 + 8192)
    for row in bits.collect():  # at most 512 parts of 4 KB
        at = (row.part - 1) * 4096 if row.part else FILTER_BITS // 8
        whole[at : at + len(row.bits)] = row.bits
    return bytes(whole)


def in_filter(bits: bytes, node: bytes) -> bool:
    place = int.from_bytes(node[:4], "big") % FILTER_BITS
    # bitmap parts count from 1 and begin at place 1; place 0 has a part of its own
    at = (place - 1, (place - 1) // 8) if place else (0, FILTER_BITS // 8)
    return bool(bits[at[1]] >> (at[0] % 8) & 1)


def in_filter_all(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places are in a filter, given as bytes; laid out as in ``in_filter``."""
    byte = np.where(places > 0, (places - 1) >> 3, FILTER_BITS // 8)
    bit = np.where(places > 0, (places - 1) & 7, 0)
    return (bits[byte] >> bit & 1).astype(bool)


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (``a``, ``b``) whose packed sets (``node``, ``members``) have Jaccard similarity of at least share[0] / share[1]."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"of_{c}"))
    full = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                common, union = jaccard_counts(a.as_py(), b.as_py())
                fits.append(share[1] * common >= share[0] * union)
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    return full.mapInArrow(check, "a binary, b binary")


def members(df: DataFrame, pairs: DataFrame, sets_of: Callable[[list], tuple[np.ndarray, np.ndarray, list]], columns: list[str]) -> DataFrame:
    """Packed sets (``node``, ``members``) of the nodes in ``pairs``; ``sets_of`` gives values, starts and nodes of a column of texts."""
    shared = df.sparkSession.sparkContext.broadcast(node_filter(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, nodes = sets_of([c.to_pylist() for c in batch.columns])
            found = {n: k for k, n in enumerate(nodes) if n is not None and in_filter(shared.value, n)}
            packed = [values[starts[k] : starts[k + 1]].astype("<u8").tobytes() for k in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(packed, pa.binary())], names=["node", "members"])

    found = df.select(*columns).mapInArrow(run, "node binary, members binary")
    return materialize(found.groupBy("node").agg(F.first("members").alias("members")), "sets")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``links`` (``a``, ``b``).

    Each round, a node takes the least of itself and its neighbours, then what that one took; links between what
    nodes took are the next round's, about half or fewer, until none is left. The rounds are then put together from the last.
    """

    def undirected(a: str, b: str, pairs: DataFrame) -> DataFrame:
        return materialize(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")

    edges, rounds = undirected("a", "b", links), []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        near = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("near"))
        near = materialize(near, "labels")
        further = near.select(F.col("node").alias("near"), F.col("near").alias("component"))
        taken = materialize(near.join(further, "near").select("node", "component"), "labels")
        rounds.append(taken)
        of = lambda c: taken.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        edges = undirected("of_a", "of_b", edges.join(of("a"), "a").join(of("b"), "b"))
    found = rounds.pop() if rounds else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for taken in reversed(rounds):
        onward = found.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        found = taken.join(onward, "component", "left").select("node", F.coalesce("onward", "component").alias("component"))
    return materialize(found, "labels")
