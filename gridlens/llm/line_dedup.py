"""Removal of repeated lines by an exact set-similarity join.

A line's set are its distinct words (runs without ASCII white space). Lines with equal sets are one
class. Words are ordered by rarity, as counted over all lines in a table of ``COUNTERS`` hashed counters, ties
by hash; any common order is correct, and a counter is never below the word's true number of lines. Two
lines of Jaccard similarity of at least ``SHARE`` share a word among the first ``n - ceil(SHARE * n) + 1`` of each in that order,
so classes meet by these prefix words. Words counted once meet nobody and are left out. A pair that meets
has to pass the length filter, the positional filter, and a bound on the overlap from bit parities of both
sets, of 64 bits for short lines and up to 1,024 for long ones; then similarity is checked on the full sets.

Prefix words and lines are shuffled as blocks: a row holds many of them from one task, packed, for a range of hashes.
Of two lines that meet, the one of fewer words has to share one of a shorter prefix, as it can differ from the other by less.

A line goes if it matches a line before it (by document, then line), whether that one stays or not; so it needs
one confirmed pair with an earlier class, and only pairs for lines without one are looked for. A task that holds all
classes with a prefix word emits all pairs of a line that meets few there, which decides it; of a line that meets many, it emits the one whose parities
are nearest, and only that of all its words is checked. Such lines, if not confirmed, are compared
again with more, in the last of the ``ROUNDS`` (at once, for ``FEW`` lines) with all, by parities of 1,024 bits, against lines that share a prefix word with them and are of like size;
filters of fixed size pick these out before anything is shuffled (where they fill up, more is shuffled, nothing missed). Words above ``TILE`` lines are split into blocks that meet
pairwise in tasks of their own.

Cases: lines without words always stay; a null text stays null; text is split at line feeds only; rows that
repeat an id count as documents in the order they are read; a null id comes first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.links import FILTER_BITS, in_filter_all, node_filter, place_filter, verified
from gridlens.llm.order import Numbered
from gridlens.llm.words import distinct, hashes_in, mix, order_within, set_numbers, word_hashes
from gridlens.session import discard, materialize

SHARE = (80, 100)
#: Hashed counters, in parts of so many; the table on every worker is one byte each (4 MB).
COUNTERS, PART = 1 << 22, 1 << 16
#: Logarithm of the tables of counters that are added up at once.
FAN_BITS = 8
#: Lines with a prefix word that one task compares; bytes of blocks it reads before it does so (about 130,000 words).
TILE, CHUNK = 16_384, 4_000_000
_CHECKSUMS = np.array([~zlib.crc32(bytes([n]), 0xFFFFFFFF) & 0xFFFFFFFF for n in range(256)], np.uint32)
#: Earlier lines, by round, that a line may pass the filters with in a task; of so many only the nearest is checked, and if that fails, the line is in the next round.
ROUNDS = (8, 64, None)
#: So few open lines go to the last round at once.
FEW = 2048
#: A prefix word is a hash whose lowest bits hold its position, up to the largest; a capped one only weakens the filter.
POS_BITS, POS_MOST = 8, 255
#: Distinct words up to which parities take 1, 2 and 4 numbers of 64 bits; lines of more words take 16. More bits only strengthen the filter.
WIDTHS = [(80, 1), (180, 2), (400, 4)]
WIDEST = 16


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of texts and the number of lines of each; a null text has none."""
    split = pc.split_pattern(texts.cast(pa.binary()), b"\n")
    return split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of every line, where each line's begin, and the number of lines of each text."""
    whole = texts.cast(pa.binary()).to_pylist()
    counts = np.array([0 if t is None else t.count(b"\n") + 1 for t in whole], dtype=np.int64)
    joined = b"\n".join([*(t for t in whole if t is not None), b""])
    return *hashes_in(joined, np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x0A) + 1), counts


def line_sets(texts: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``line_words``, of every line the distinct ones, the rarer first."""
    values, starts, counts = line_words(texts)
    return *distinct(values, starts, codes[_counter(values)]), counts


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(20) & np.uint64(COUNTERS - 1)).view(np.int64)


def _firsts(order: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first of each run of equal numbers in an order."""
    low, high = low[order], high[order]
    new = np.ones(len(order), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return order[new]


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest takes, compressed; most are zero."""
    return zlib.compress(bytes([(wide := _bytes_of(counts))]) + counts.astype(f"<u{wide}").tobytes(), 1)


def _bytes_of(counts: np.ndarray) -> int:
    return next(n for n in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * n)


def _stretched(packed: bytes) -> np.ndarray:
    whole = zlib.decompress(packed)
    return np.frombuffer(whole, f"<u{whole[0]}", offset=1).astype(np.int64)


def counted(df: DataFrame, text: str) -> DataFrame:
    """Parts (``part``) of tables of counters (``counts``), of which each ``task`` has one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(COUNTERS, dtype=np.uint32), [np.empty(0, np.int32)]
        for batch in batches:
            values, starts, _ = line_words(batch.column(0))
            filled, low, high = set_numbers(values, starts)  # lines of the same words as often are one here
            new = np.sort(filled[_firsts(np.lexsort((high, low)), low, high)])
            sizes = starts[new + 1] - starts[new]
            at = np.repeat(starts[new] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            # a line counts once for a counter, so the counters of its words are sorted, not the words
            counter = np.sort(np.repeat(np.arange(len(new)) * COUNTERS, sizes) + _counter(values[at]))
            held.append((counter[np.diff(counter, prepend=-1) > 0] % COUNTERS).astype(np.int32))
            if sum(map(len, held)) >= COUNTERS // 2:
                counts += np.bincount(np.concatenate(held), minlength=COUNTERS).astype(np.uint32)
                held = held[:1]
        counts += np.bincount(np.concatenate(held), minlength=COUNTERS).astype(np.uint32)
        if counts.any():
            parts = [_squeezed(counts[at : at + PART]) for at in range(0, COUNTERS, PART)]
            task = pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), task, pa.array(parts, pa.binary())], names=["part", "task", "counts"])

    return df.select(text).mapInArrow(count, "part int, task int, counts binary")


def added(parts: DataFrame) -> DataFrame:
    """Parts of the tables of every ``2 ** FAN_BITS`` tasks added up to one."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum(map(_stretched, rows["counts"]), np.zeros(PART, np.int64))
        return pd.DataFrame({"part": rows["part"].iloc[:1], "task": rows["task"].iloc[:1], "counts": [_squeezed(counts)]})

    fewer = parts.withColumn("task", F.shiftright("task", FAN_BITS))
    return fewer.groupBy("part", "task").applyInPandas(add, "part int, task int, counts binary")


def rarity(df: DataFrame, text: str) -> np.ndarray:
    """A code of each counter: its number of lines up to 16, above that its logarithm."""

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum(map(_stretched, rows["counts"]), np.zeros(PART, np.int64))
        codes = np.where(counts <= 16, counts, np.minimum(16 + 8 * np.log2(np.maximum(counts, 16) / 16), 255)).astype(np.uint8)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "codes": [codes.tobytes()]})

    # At most 256 tables at once: of up to 16 million tasks the last step has 256.
    parts = added(added(counted(df, text))).groupBy("part").applyInPandas(total, "part int, codes binary")
    codes = np.zeros(COUNTERS, dtype=np.uint8)
    for row in parts.collect():
        codes[row.part * PART : (row.part + 1) * PART] = np.frombuffer(row.codes, np.uint8)
    return codes


def parities(values: np.ndarray, starts: np.ndarray, by_size: list[tuple[int, int]] = WIDTHS) -> pa.Array:
    """For each run of values, which bits an odd number of them falls on; the bits of a wider one fold to those of a narrower."""
    sizes = np.diff(starts)
    widths = np.full(len(sizes), WIDEST)
    for most, width in reversed(by_size):
        widths[sizes <= most] = width
    ends = np.concatenate([[0], np.cumsum(widths)])
    bit = values >> np.uint64(54)
    ones = np.uint64(1) << (bit & np.uint64(63))
    words = np.zeros(ends[-1], dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        words[ends[filled]] = np.bitwise_xor.reduceat(ones, starts[filled])
    wide = np.repeat(widths > 1, sizes)
    if wide.any():
        words[ends[np.flatnonzero(widths > 1)]] = 0
        owner = np.repeat(np.arange(len(sizes)), sizes)[wide]
        at = ends[owner] + ((bit[wide] >> np.uint64(6)).astype(np.int64) & (widths[owner] - 1))
        np.bitwise_xor.at(words, at, ones[wide])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(words.astype("<u8"))])


#: Rows in a block; words and lines that a task packs at once.
BLOCK_ROWS, PACKED_ROWS = 2048, 1 << 17
WORD_FIELDS = ("word", "row", "id", "filled", "line", "n", "wanted", "width")
LINE_FIELDS = ("low", "high", "row", "id", "filled", "line", "n", "width", "words")
#: Logarithm of the prefix words in a bucket; buckets that lines are dealt to, at least, and for each shuffle partition.
BUCKET_BITS, LINE_BUCKETS, BUCKETS_EACH = 17, 256, 4


def numbers_of(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of 64 bits in binary values, where each value's begin, and how many it has."""
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // 8
    return np.frombuffer(packed.buffers()[2], np.uint8)[: 8 * ends[-1]].view("<u8"), ends[:-1], np.diff(ends)


def flat(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signed numbers of 64 bits in binary values, one after the other, and how many each value has."""
    if not pc.sum(pc.binary_length(packed)).as_py():
        return np.empty(0, np.int64), np.zeros(len(packed), np.int64)
    numbers, begin, count = numbers_of(packed)
    return numbers[begin[0] :].view(np.int64), count


def taken(numbers: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of numbers, one after the other."""
    ends = np.cumsum(count)
    return numbers[np.repeat(begin - (ends - count), count) + np.arange(count.sum())]


def blocks_of(hashes: np.ndarray, buckets: int, fields: list[np.ndarray], streams: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows in the order of ``hashes`` as blocks of a ``bucket``, a range of hashes: records, and streams of numbers of which each row has so many.

    A record holds each field as the least bytes above its smallest value; ``head`` has these values and how many bytes.
    """
    lows = np.array([v.min() for v in fields])
    values = [v.view(np.uint64) - low.view(np.uint64) for v, low in zip(fields, lows, strict=True)]
    wide = np.array([max((int(v.max()).bit_length() + 7) // 8, k == 0) for k, v in enumerate(values)])  # the first tells how many records there are
    records = np.concatenate([v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w] for v, w in zip(values, wide, strict=True)], axis=1)
    bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    run = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    cut = np.concatenate([np.arange(a, a + n, BLOCK_ROWS) for a, n in zip(run, np.diff(run, append=len(hashes)), strict=True)])
    offsets = np.append(cut, len(hashes))

    def binary(at: np.ndarray, data: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    head = np.concatenate([lows, wide]).astype("<i8").tobytes()
    columns = [pa.array(bucket[cut].astype(np.int32)), pa.array([head] * len(cut), pa.binary()), binary(offsets * int(wide.sum()), records)]
    columns += [binary(8 * np.concatenate([[0], np.cumsum(count)])[offsets], numbers) for numbers, count in streams]
    names = ["bucket", "head", "records", "bits", "words"]
    return pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])


def opened(blocks: list[tuple[bytes, ...]], names: tuple[str, ...]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Fields of the rows in blocks, one after the other, and the numbers of each stream."""
    alike: dict[bytes, list[tuple[bytes, ...]]] = {}
    for block in blocks:
        alike.setdefault(block[0], []).append(block)
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for head, same in alike.items():
        lows, wide = np.frombuffer(head, "<i8").reshape(2, -1)
        table = np.frombuffer(b"".join(b[1] for b in same), np.uint8).reshape(-1, int(wide.sum()))
        for part, low, end, w in zip(parts, lows, np.cumsum(wide), wide, strict=True):
            whole = np.zeros((len(table), 8), np.uint8)
            whole[:, :w] = table[:, end - w : end]
            part.append(whole.view("<i8").ravel() + low)
    ordered = [b for same in alike.values() for b in same]
    streams = [np.frombuffer(b"".join(b[k] for b in ordered), "<u8") for k in range(2, len(blocks[0]))]
    return {f: np.concatenate(p) for f, p in zip(names, parts, strict=True)}, streams


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, ...]]]:
    """Blocks of whole buckets, as soon as they have ``CHUNK`` bytes."""
    held: list[tuple[bytes, ...]] = []
    size, last = 0, -1
    for batch in batches:
        for bucket, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and size >= CHUNK:
                yield held
                held, size = [], 0
            last = bucket
            size += sum(map(len, block))
            held.append(tuple(block))
    if held:
        yield held


def binary_runs(numbers: np.ndarray, count: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], 8 * np.cumsum(count)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(numbers))])


class Parities:
    """Parities of rows, in the order of ``order``."""

    def __init__(self, packed: pa.Array, order: np.ndarray):
        self.words, begin, width = numbers_of(packed)
        self.begin, self.width = begin[order], width[order]
        self.folded = np.bitwise_xor.reduceat(self.words, begin)[order]

    def _of(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Parities of rows, folded to ``width`` numbers."""
        out = np.empty((len(rows), width), np.uint64)
        for wide in np.unique(self.width[rows]):
            here = np.flatnonzero(self.width[rows] == wide)
            whole = self.words[self.begin[rows[here], None] + np.arange(wide)]
            out[here] = np.bitwise_xor.reduce(whole.reshape(len(here), wide // width, width), axis=1)
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At most as many values as are in one of two rows only; ``a`` is not wider than ``b``."""
        out = np.bitwise_count(self.folded[a] ^ self.folded[b]).astype(np.int64)
        widths = self.width[a]
        wide = np.flatnonzero(widths > 1)
        for width in np.unique(widths[wide]) if len(wide) else ():
            here = wide[widths[wide] == width]
            out[here] = np.bitwise_count(self._of(a[here], width) ^ self._of(b[here], width)).sum(axis=1)
        return out


def prefixes(values: np.ndarray, starts: np.ndarray, codes: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Prefix words that may be shared: their lines, positions and hashes; and the parities of every line."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return prefixes_of_ordered(values[order_within(owner, values, len(starts) - 1, codes[_counter(values)])], starts, codes, share)


def prefixes_of_ordered(values: np.ndarray, starts: np.ndarray, codes: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """As ``prefixes``, for lines whose words have the rarer first."""
    bits = parities(values, starts)
    sizes = np.diff(starts)
    length = np.where(sizes > 0, sizes - -(-share[0] * sizes // share[1]) + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), length)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    first = values[starts[owner] + place]
    wanted = codes[_counter(first)] > 1
    return owner[wanted], place[wanted], first[wanted], bits


def _meetings(
    token: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: Parities, first: np.ndarray, share: tuple[int, int], wanted: np.ndarray | None = None, most: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``_measured``."""
    for a, b, _ in _measured(token, n, pos, bits, first, share, wanted, most):
        yield a, b


def _measured(
    token: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: Parities, first: np.ndarray, share: tuple[int, int], wanted: np.ndarray | None = None, most: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by token and size) that share a token and pass all filters, the one of lower ``first`` in front; and how far apart parities are.

    Of two lines the one of fewer words shares one of its first ``n - ceil(2 * share / (1 + share) * n) + 1`` words with the other's prefix.
    With ``wanted`` only those whose later row is; with ``most``, no further ones for a later row that has so many.
    """
    if not len(token):
        return
    found = np.zeros(len(token), np.int64)
    early = pos <= n - -(-2 * share[0] * n // (share[0] + share[1]))
    # rows of a token are in the order of size: those that a row may meet end at the last of like size
    runs_at = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) * (int(n.max()) + 1)
    last = np.searchsorted(runs_at + n, runs_at + np.minimum(share[1] * n // share[0], n.max()), "right") - 1
    alive, shift = np.flatnonzero(early), 1
    ends = last[alive]
    while len(alive):
        near = alive + shift <= ends
        alive, ends = alive[near], ends[near]
        a, b = alive, alive + shift
        later = np.where(first[a] < first[b], b, a)
        asked = first[a] != first[b]
        if wanted is not None:
            asked &= wanted[later]
        if most is not None:
            asked &= found[later] < most
        a, b = a[asked], b[asked]
        for bound in ("bits", "place", "all bits"):
            if bound == "bits":
                most_common = (n[a] + n[b] - np.bitwise_count(bits.folded[a] ^ bits.folded[b])) // 2
            elif bound == "place":
                most_common = np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b])
            else:
                apart = bits.apart(a, b)
                most_common = (n[a] + n[b] - apart) // 2
            fits = (share[0] + share[1]) * most_common >= share[0] * (n[a] + n[b])
            a, b = a[fits], b[fits]
        if len(a):
            ahead = first[a] < first[b]
            a, b = np.where(ahead, a, b), np.where(ahead, b, a)
            np.add.at(found, b, 1)
            yield a, b, apart[fits]
        shift += 1


def packed_nodes(rows: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Names of lines, 16 bytes in a row each: a checksum, then the numbers of the row and of the line in it; as ``_node``."""
    packed = np.empty((len(rows), 16), np.uint8)
    packed[:, 4:12] = rows.astype(">i8")[:, None].view(np.uint8)
    packed[:, 12:] = lines.astype(">i4")[:, None].view(np.uint8)
    checksum = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for byte in packed[:, 4:].T:
        checksum = _CHECKSUMS[(checksum & np.uint32(0xFF)) ^ byte] ^ (checksum >> np.uint32(8))
    packed[:, :4] = (~checksum).astype(">u4")[:, None].view(np.uint8)
    return packed


def nodes_of(rows: np.ndarray, lines: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(packed_nodes(rows, lines).tobytes())]).cast(pa.binary())


def _node(row: Column, line: Column) -> Column:
    digits = lambda value, n: F.unhex(F.lpad(F.hex(value), n, "0"))
    name = F.concat(digits(row.cast("long"), 16), digits(line.cast("long"), 8))
    return F.concat(digits(F.crc32(name), 8), name)


def _marked(rows: np.ndarray, lines: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which lines are in a filter of nodes."""
    checksums = np.ascontiguousarray(packed_nodes(rows, lines)[:, :4]).view(">u4").ravel()
    return in_filter_all(bits, checksums.astype(np.int64) % FILTER_BITS)


def _size_places(word: np.ndarray, n: np.ndarray, share: tuple[int, int], further: int = 0) -> np.ndarray:
    """Places in a filter for a word with the size class of its line; partners are at most one class apart."""
    size = np.floor(np.log(n) / max(1.01 * math.log(share[1] / share[0]), 1e-3)).astype(np.int64) + further + 2
    return (mix((word >> POS_BITS).view(np.uint64) ^ mix(size.astype(np.uint64))) >> np.uint64(20)).astype(np.int64) % FILTER_BITS


def _places(nodes: DataFrame) -> DataFrame:
    """``row`` and ``line`` of each ``node``."""
    number = lambda at, n: F.conv(F.hex(F.substring("node", at, n)), 16, 10)
    return nodes.select(number(5, 8).cast("long").alias("row"), number(13, 4).cast("int").alias("line"))


def _open_words(classes: DataFrame, rest: DataFrame, share: tuple[int, int]) -> bytes:
    """A filter of what the classes in ``rest`` (``node``) may meet: prefix words with size classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, times = flat(batch.column(1))
            n = np.repeat(batch.column(0).to_numpy(), times)
            places = np.unique(np.concatenate([_size_places(word, n, share, step) for step in (-1, 0, 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(places)], names=["place"])

    asked = classes.select("row", "line", "n", "prefix").join(_places(rest), ["row", "line"], "left_semi")
    return place_filter(asked.select("n", "prefix").mapInArrow(run, "place long"))


def _words(classes: DataFrame, rest: DataFrame | None, share: tuple[int, int]) -> DataFrame:
    """Classes with their prefix words; with ``rest`` (``node``) only those words that may meet a class in it, which is wanted."""
    if rest is None:
        return classes.withColumn("wanted", F.lit(True))
    wanted = node_filter(rest.select(F.col("node").alias("a"), F.col("node").alias("b")))
    shared = classes.sparkSession.sparkContext.broadcast((wanted, _open_words(classes, rest, share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_bits, near_bits = (np.frombuffer(b, np.uint8) for b in shared.value)
        for batch in batches:
            word, times = flat(batch.column(5))
            owner, n = np.repeat(np.arange(batch.num_rows), times), batch.column(3).to_numpy()
            near = in_filter_all(near_bits, _size_places(word, n[owner], share))
            if near.any():
                met, times = np.unique(owner[near], return_counts=True)
                left = binary_runs(word[near], times)
                asked = _marked(batch.column(0).to_numpy()[met], batch.column(2).to_numpy()[met], asked_bits)
                columns = [batch.column(c).take(pa.array(met)) for c in range(5)]
                yield pa.RecordBatch.from_arrays([*columns, left, pa.array(asked)], names=["row", "id", "line", "n", "bits", "prefix", "wanted"])

    rows = classes.select("row", "id", "line", "n", "bits", "prefix")
    return rows.mapInArrow(run, "row long, id long, line int, n int, bits binary, prefix binary, wanted boolean")


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Prefix words of classes in the order of their hashes, as blocks of a ``bucket``: a range of hashes."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = {c: table[c].chunk(0) for c in table.column_names}
        word, times = flat(column["prefix"])
        order = np.argsort(word.view(np.uint64))
        word = word[order]
        owner = np.repeat(np.arange(len(table)), times)[order]
        parity, begin, width = numbers_of(column["bits"])
        whole = {"id": column["id"].fill_null(0), "filled": column["id"].is_valid(), "width": pa.array(width)}
        fields = [word if f == "word" else whole.get(f, column.get(f)).to_numpy(zero_copy_only=False).astype(np.int64)[owner] for f in WORD_FIELDS]
        return blocks_of(word.view(np.uint64), buckets, fields, [(taken(parity, begin[owner], width[owner]), width[owner])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            size += (pc.sum(pc.binary_length(batch.column(5))).as_py() or 0) // 8
            held.append(batch)
            if size >= PACKED_ROWS:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    columns = rows.select("row", "id", "line", "n", "bits", "prefix", "wanted")
    return columns.mapInArrow(run, "bucket int, head binary, records binary, bits binary")


def _candidates(rows: DataFrame, share: tuple[int, int], most: int | None) -> DataFrame:
    """Distinct pairs of classes (nodes ``a``, ``b``) of which ``rows`` meet, ``a`` before a wanted ``b``.

    Where a ``b`` passes the filters with ``most`` or more in a task, there are ``more`` than the one pair given.
    """

    def pairs(blocks: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
        fields, (parity,) = opened(blocks, WORD_FIELDS)
        row, line, n = fields["row"], fields["line"], fields["n"]
        token, pos = fields["word"] >> POS_BITS, fields["word"] & POS_MOST
        first = np.empty(len(token), np.int64)
        first[np.lexsort((line, row, fields["id"], fields["filled"]))] = np.arange(len(token))
        order = np.lexsort((first, n, token))
        bits = Parities(binary_runs(parity, fields["width"]), order)
        row, line, n = row[order], line[order], n[order]

        def emit(a: np.ndarray, b: np.ndarray, apart: np.ndarray, more: bool) -> pa.RecordBatch:
            columns = [nodes_of(row[a], line[a]), nodes_of(row[b], line[b]), pa.array(apart), pa.array(np.full(len(a), more))]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "apart", "more"])

        found, nearest, near = np.zeros(len(token), np.int32), np.full(len(token), np.inf), np.zeros(len(token), np.int32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b, apart in _measured(token[order], n, pos[order], bits, first[order], share, fields["wanted"][order] > 0, most):
            if most is None:
                yield emit(a, b, np.zeros(len(a)), False)
                continue
            apart = apart / (n[a] + n[b])
            for at in (np.flatnonzero(a < b), np.flatnonzero(a > b)):  # in each, no row is twice the later one
                at = at[apart[at] < nearest[b[at]]]
                nearest[b[at]], near[b[at]] = apart[at], a[at]
            np.add.at(found, b, 1)
            held.append((a.astype(np.int32), b.astype(np.int32)))
        if held:
            a, b = (np.concatenate(ends) for ends in zip(*held, strict=True))
            few = found[b] < most
            many = np.flatnonzero(found >= most)
            yield emit(a[few], b[few], np.zeros(few.sum()), False)
            yield emit(near[many], many, nearest[many], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in runs(batches):
            yield from pairs(blocks)

    words = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1)).first()[0] or 0
    blocks = dealt(rows, max(64, int(words) >> BUCKET_BITS))
    met = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a binary, b binary, apart double, more boolean")
    met = met.where("a <> b")
    if most is None:
        return met.select("a", "b", "more").distinct()
    # a line's few pairs per word, or the nearest of those of the words where there are more
    nearest = F.min(F.when(F.col("more"), F.struct("apart", "a"))).alias("nearest")
    lines = met.groupBy("b").agg(F.max("more").alias("more"), F.collect_set(F.when(~F.col("more"), F.col("a"))).alias("all"), nearest)
    ends = F.when(F.col("more"), F.array("nearest.a")).otherwise(F.col("all"))
    return lines.select(F.explode(ends).alias("a"), "b", "more")


def unmatched(df: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """For rows (``row``, ``id``, ``text``): each line with words (``row``, ``line``) that matches no earlier one."""
    shared = df.sparkSession.sparkContext.broadcast(rarity(df, "text").tobytes())

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        codes = np.frombuffer(shared.value, np.uint8)
        tiles_of = 1 + np.where(np.arange(256) > 16, 16 * 2.0 ** ((np.arange(256) - 15) / 8), 0).astype(np.int64) // TILE
        for batch in batches:
            values, starts, counts = line_sets(batch.column(2), codes)
            sizes = np.diff(starts)
            owner, place, tokens, bits = prefixes_of_ordered(values, starts, codes, share)
            tiles = tiles_of[codes[_counter(tokens)]]
            if (tiles > 1).any():  # a block meets every block of the word, in a task for each two
                own = (mix(Parities(bits, np.arange(len(sizes))).folded[owner] + np.uint64(1)) % tiles.astype(np.uint64)).astype(np.int64)
                times = np.repeat(np.arange(len(tiles)), tiles)
                with_block = np.arange(len(times)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                low, high = np.minimum(own[times], with_block), np.maximum(own[times], with_block)
                salt = np.where(tiles[times] > 1, low * tiles[times] + high, 0).astype(np.uint64)
                owner, place, tokens = owner[times], place[times], np.where(salt > 0, mix(tokens[times] + salt), tokens[times])
            words = (tokens.view(np.int64) & ~POS_MOST) | np.minimum(place, POS_MOST)
            text = np.repeat(np.arange(len(counts)), counts)
            line = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
            filled, low, high = set_numbers(values, starts)
            of = batch.column(1).take(pa.array(text[filled]))
            fields = [low.view(np.int64), (high >> np.uint64(32)).view(np.int64), batch.column(0).to_numpy()[text[filled]], of.fill_null(0).to_numpy(), of.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)]
            parity, _, width = numbers_of(bits)
            # lines without words have parities, but no prefix words
            times = np.bincount(owner, minlength=len(sizes))[filled]
            ends = np.concatenate([[0], np.cumsum(width)])
            parity = taken(parity, ends[filled], width[filled])
            yield [*fields, line[filled], sizes[filled], width[filled], times], parity, words.view(np.uint64)

    def pack(held: list) -> pa.RecordBatch:
        fields, (parity, words) = [np.concatenate(f) for f in zip(*(h[0] for h in held), strict=True)], (np.concatenate([h[k] for h in held]) for k in (1, 2))
        at = first_of_each(dict(zip(LINE_FIELDS, fields, strict=True)))
        width, times = fields[-2], fields[-1]
        streams = [(taken(x, (np.cumsum(count) - count)[at], count[at]), count[at]) for x, count in ((parity, width), (words, times))]
        return blocks_of(fields[0][at].view(np.uint64), buckets, [f[at] for f in fields], streams)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in lines(batches):
            held.append(found)
            size += len(found[0][0]) + len(found[2])
            if size >= PACKED_ROWS:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    def first_of_each(fields: dict[str, np.ndarray]) -> np.ndarray:
        """The first line of each set, in the order of the sets' numbers."""
        low, high = fields["low"].view(np.uint64), fields["high"]
        return _firsts(np.lexsort((fields["line"], fields["row"], fields["id"], fields["filled"], high, low)), low, high)

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in runs(batches):
            fields, (parity, words) = opened(blocks, LINE_FIELDS)
            at = first_of_each(fields)
            begin = {c: np.cumsum(fields[c]) - fields[c] for c in ("width", "words")}
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                f = {c: v[some] for c, v in fields.items()}
                columns = [
                    pa.array(f["row"]), pa.array(f["id"], mask=f["filled"] == 0), pa.array(f["line"], pa.int32()), pa.array(f["n"], pa.int32()),
                    binary_runs(taken(parity, begin["width"][some], f["width"]), f["width"]),
                    binary_runs(taken(words, begin["words"][some], f["words"]), f["words"]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "line", "n", "bits", "prefix"])

    buckets = max(LINE_BUCKETS, BUCKETS_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.select("row", "id", "text").mapInArrow(packed, "bucket int, head binary, records binary, bits binary, words binary")
    found = found.repartition("bucket").sortWithinPartitions("bucket")
    classes = found.mapInArrow(first_lines, "row long, id long, line int, n int, bits binary, prefix binary")
    # from here on a class goes by the place of its first line
    classes = materialize(classes, "line-classes")

    rest, links, written, few = None, None, [classes], False
    for most in ROUNDS:
        if few and most is not None:
            continue
        rows = _words(classes, rest, share)
        if rest is not None:
            near = materialize(rows, "line-near")
            # written, as it is read twice, and as a task that also packs it would hold two Python workers
            rows = materialize(_with_widest(df, near), "line-widest")
            discard(near)
            written.append(rows)
        met = materialize(_candidates(rows, share, most), "line-pairs")
        sets = _sets(df, met)
        new = materialize(verified(met, sets, share), "line-links")
        discard(sets)
        written += [met, new]
        links = new if links is None else links.unionByName(new)
        matched = links.select(F.col("b").alias("node")).distinct()
        if most is None:
            break
        rest = met.where("more").select(F.col("b").alias("node"))
        rest = materialize(rest.join(matched, "node", "left_anti"), "line-open")
        written.append(rest)
        open_lines = rest.count()
        if not open_lines:
            break
        few = open_lines <= FEW
    found = materialize(classes.select("row", "line").join(_places(matched), ["row", "line"], "left_anti"), "line-unmatched")
    discard(*written)
    return found


def _hashed_again(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and numbers of the lines in a filter of nodes, and their sets, for batches of rows and texts."""
    for batch in batches:
        lines, counts = lines_of(batch.column(1))
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rows = np.repeat(batch.column(0).to_numpy(), counts)
        asked = np.flatnonzero(_marked(rows, number, bits))
        if len(asked):
            yield rows[asked], number[asked], *distinct(*word_hashes(lines.take(pa.array(asked)).to_pylist()))


def _sets(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Packed sets (``node``, ``members``) of the lines in ``pairs``; only these lines are hashed."""
    shared = df.sparkSession.sparkContext.broadcast(node_filter(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lines, values, starts in _hashed_again(batches, np.frombuffer(shared.value, np.uint8)):
            packed = [values[a:b].astype("<u8").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([nodes_of(rows, lines), pa.array(packed, pa.binary())], names=["node", "members"])

    return materialize(df.select("row", "text").mapInArrow(run, "node binary, members binary"), "line-sets")


def _with_widest(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with parities of 1,024 bits, which are all but exact for short lines; only the lines in ``rows`` are hashed."""
    checksum = F.conv(F.hex(F.substring(_node(F.col("row"), F.col("line")), 1, 4)), 16, 10).cast("long")
    shared = df.sparkSession.sparkContext.broadcast(place_filter(rows.select(F.pmod(checksum, F.lit(FILTER_BITS)).alias("place"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, line, values, starts in _hashed_again(batches, np.frombuffer(shared.value, np.uint8)):
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(line, pa.int32()), parities(values, starts, [])], names=["row", "line", "bits"])

    wide = df.select("row", "text").mapInArrow(run, "row long, line int, bits binary")
    return rows.drop("bits").join(wide, ["row", "line"])


REMOVED = "lines_removed"


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE, count: str | None = None) -> DataFrame:
    """Every row of ``df`` with its text without lines that match an earlier one, and the numbers of the lines taken out in ``lines_removed``.

    With ``count``, a column of this name has the number of lines that the text had.
    """
    table = Numbered(df)
    found = unmatched(table.select(id=F.col(id).cast("long"), text=F.col(text)), share)
    kept = found.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("kept"))
    kept = materialize(kept.select(F.col("row").alias("kept_row"), "kept"), "line-kept")
    discard(found)
    rest = df.drop(REMOVED, *([count] if count else []))
    names = rest.columns
    # numbers of a row's lines are fewer than its text, so they are hashed and texts need no sort
    joined = table.select(own=F.struct(*names)).join(kept.hint("shuffle_hash"), F.col("row") == F.col("kept_row"), "left").select("own.*", "kept")
    added = [F.array(F.lit(0)).alias(REMOVED)] + ([F.lit(0).cast("long").alias(count)] if count else [])
    fields = rest.select("*", *added).schema
    column = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, had = [], [], []
            for whole, stay in zip(batch.column(column).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if whole is None:
                    texts.append(None)
                    removed.append([])
                    had.append(0)
                    continue
                stay, lines = set(stay or ()), whole.split("\n")
                had.append(len(lines))
                # white space as in the words of the sets
                gone = [n for n, line in enumerate(lines) if n not in stay and line.strip(" \t\n\v\f\r")]
                without = set(gone)
                texts.append("\n".join(line for n, line in enumerate(lines) if n not in without) if gone else whole)
                removed.append(gone)
            columns = list(batch.columns[:-1])
            columns[column] = pa.array(texts, columns[column].type)
            columns += [pa.array(removed, pa.list_(pa.int32()))] + ([pa.array(had, pa.int64())] if count else [])
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    return joined.mapInArrow(cut, fields)
