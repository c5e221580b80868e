"""Features as bin numbers, the input of tree learners.

A feature's borders are quantiles of its training values, at most ``BINS`` - 1 of them. The code of a value is the number of borders below it, so
``code <= b`` and ``value <= borders[b]`` are the same question: trees are grown on codes of one byte and applied to plain values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
BLOCK_ROWS = 8_192  # rows of a training block
PRECISION = 1e-3  # of the quantiles, as a share of the rows


@dataclass
class Borders:
    names: list[str]
    values: np.ndarray  # a row per feature, filled up with infinity

    @classmethod
    def fit(cls, df: DataFrame, names: Sequence[str], bins: int = BINS) -> Borders:
        shares = [k / bins for k in range(1, bins)]
        values = np.full((len(names), bins - 1), np.inf)
        for row, found in zip(values, df.approxQuantile(list(names), shares, PRECISION), strict=True):
            distinct = np.unique(found)
            row[: len(distinct)] = distinct
        return cls(list(names), values)

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        """Codes of a batch's rows, a row per feature."""
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in self.names]
        return np.stack([np.searchsorted(b, x, side="left") for b, x in zip(self.values, columns, strict=True)]).astype(np.uint8)


def flat(nodes: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Nodes (tree, node, below, above) sorted by tree and node with children as places in the table, and the places of the roots."""
    place = {key: k for k, key in enumerate(zip(nodes["tree"], nodes["node"], strict=True))}
    children = {c: np.array([place[key] for key in zip(nodes["tree"], nodes[c], strict=True)], dtype=int) for c in ("below", "above")}
    return nodes.assign(**children), np.flatnonzero(~nodes["tree"].duplicated().to_numpy())


def row_number(key: Sequence[str]) -> Column:
    """64 bits that stand for a row's key in random draws."""
    return F.xxhash64(*key)


def mixed(numbers: np.ndarray, seed: int) -> np.ndarray:
    """A share from 0 to 1 for each row number, different for each seed."""
    x = numbers.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def coded_rows(df: DataFrame, borders: Borders, label: str, key: Sequence[str]) -> DataFrame:
    """``number``, ``label`` and ``codes`` (a byte per feature) of every labelled row."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.ascontiguousarray(borders.codes(batch).T).tobytes()
            size = len(borders.names)
            rows = [packed[n * size : (n + 1) * size] for n in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["number", "label", "codes"])

    plain = df.where(F.col(label).isNotNull())
    plain = plain.select(row_number(key).alias("number"), F.col(label).cast("int").alias("label"), *[F.col(n).cast("double") for n in borders.names])
    return plain.mapInArrow(code, "number long, label int, codes binary")


def coded_blocks(df: DataFrame, borders: Borders, label: str, key: Sequence[str]) -> DataFrame:
    """Blocks of up to ``BLOCK_ROWS`` rows: packed numbers, labels and codes (feature by feature)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            number, label_ = (rows.column(n).to_numpy() for n in ("number", "label"))
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(number), -1)
            columns = [number.astype("<i8").tobytes(), label_.astype(np.uint8).tobytes(), np.ascontiguousarray(codes.T).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["numbers", "labels", "codes"])

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if held + part.num_rows > BLOCK_ROWS:
                    yield block()
                    waiting, held = [], 0
                waiting.append(part)
                held += part.num_rows
        if held:
            yield block()

    return coded_rows(df, borders, label, key).mapInArrow(pack, "numbers binary, labels binary, codes binary")
