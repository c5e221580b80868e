"""Sum-of-squares packing of documents into sequences of fixed length.

Documents arrive one by one. Full sequences are cut off a document first; what is left over is placed
in the window whose fill level makes the sum over levels of the squared number of partly filled
windows smallest, a new window included; ties go to the fullest. The counts are kept in a level array.

Every task packs the documents of its partition, so nothing is shuffled. When ``OPEN_WINDOWS`` are open, or
at the end of the partition, the pieces in open windows are poured into full sequences, cut where one is
full; the last remainder is cut into sequences of powers of two, which need no padding.

Cases: a null or empty text is one end token; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlens.llm.units import KEPT_UNITS, blocks, small_batches, units

LENGTH, END_ID = 2048, 1
#: Windows a task keeps open; above that their pieces are poured together.
OPEN_WINDOWS = 4096
#: Sequence numbers of a task start at its number times this.
TASK_SPAN = 1 << 32
#: New units of text that are encoded in one call.
JOINED = 64
#: A space that is first or follows white space, of any kind ``str.isspace`` knows.
SPACED = r"^ |[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
NAMES = ["start", "length", "doc_tokens", "sequence_id", "offset", "tokens"]


class Packer:
    """Online packing; ``add`` and ``close`` yield placed pieces (doc, start, total, sequence, offset, ids)."""

    def __init__(self, length: int, first: int):
        self.length, self.next = length, first
        self.levels = np.zeros(length + 1, dtype=np.int64)
        self.windows: dict[int, list[list[tuple]]] = {}
        self.open = 0

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, total, ids in pieces:
            yield doc, start, total, self.next, offset, ids
            offset += len(ids)
        self.next += 1

    def place(self, size: int) -> int:
        """The level to which a piece of ``size`` is added; 0 opens a window."""
        n, room = self.levels, self.length - size
        after = 2 * n[size : self.length + 1] + 1  # a window arrives at level + size
        after[-1] = 0  # a full one counts no more
        cost = after - 2 * n[: room + 1] + 1  # and leaves its level
        cost[0] = after[0]
        usable = n[: room + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return room - int(np.argmin(cost[::-1]))

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        whole = total - total % self.length
        for at in range(0, whole, self.length):
            yield from self._sequence([(doc, at, total, ids[at : at + self.length])])
        size = total - whole
        if not size:
            return
        level = self.place(size)
        pieces = []
        if level:
            pieces = self.windows[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        pieces.append((doc, whole, total, ids[whole:]))
        if level + size == self.length:
            yield from self._sequence(pieces)
            return
        self.windows.setdefault(level + size, []).append(pieces)
        self.levels[level + size] += 1
        self.open += 1
        if self.open >= OPEN_WINDOWS:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        """Pour what is open into full sequences and a remainder of powers of two."""
        left = [p for level in sorted(self.windows, reverse=True) for window in self.windows[level] for p in window]
        room = sum(len(p[-1]) for p in left)
        self.windows, self.open = {}, 0
        self.levels[:] = 0
        pieces, fill, target = [], 0, min(self.length, 1 << max(room.bit_length() - 1, 0))
        for doc, start, total, ids in left:
            at = 0
            while at < len(ids):
                part = ids[at : at + target - fill]
                pieces.append((doc, start + at, total, part))
                at += len(part)
                fill += len(part)
                if fill == target:
                    yield from self._sequence(pieces)
                    room -= target
                    pieces, fill, target = [], 0, min(self.length, 1 << max(room.bit_length() - 1, 0))


class Texts:
    """Ids of texts by a tokenizer file; each unit of text a task has not met yet goes through the library.

    A text is cut and its units are told apart in Arrow; the ids of units lie in one array, of which ``kept`` has the places.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer)
        # only where the pattern alone cuts the text are units independent of each other
        parts, spec = json.loads(tokenizer)["pre_tokenizer"], json.loads(tokenizer)
        self.cut = parts["type"] == "ByteLevel" and parts.get("use_regex", True) and not parts["add_prefix_space"] and not spec["normalizer"]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character of a byte-level token is a byte
        for token in spec.get("added_tokens") or []:
            self.bytes_of[token["id"]] = len(token["content"].encode())
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and the number of each."""
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def _encode_units(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode``, ``JOINED`` units to a text; the bytes of the tokens tell where a unit ends.

        The pattern cuts between them, as each begins at a space and ends in something else.
        """
        sizes = np.cumsum([len(u.encode()) for u in new])
        ids, _ = self._encode(["".join(new[at : at + JOINED]) for at in range(0, len(new), JOINED)])
        reached = np.cumsum(self.bytes_of[ids])
        ends = np.searchsorted(reached, sizes)
        if len(reached) and ends[-1] + 1 == len(ids) and (reached[ends] == sizes).all():
            return ids, np.diff(ends + 1, prepend=0)
        return self._encode(new)  # a tokenizer that leaves bytes out

    def _numbers(self, found: list[str]) -> np.ndarray:
        """The place of each of the (distinct) units."""
        new = [u for u in found if u not in self.kept]
        if len(self.kept) + len(new) > KEPT_UNITS and self.kept:
            self._forget()
            new = found
        plain = [u for u in new if u[:1] == " " and not u[-1].isspace()]
        others = [u for u in new if u[:1] != " " or u[-1].isspace()]
        for units_of, encode in ((plain, self._encode_units), (others, self._encode)):
            if units_of:
                ids, counts = encode(units_of)
                self.kept.update(zip(units_of, range(len(self.ends) - 1, len(self.ends) - 1 + len(units_of)), strict=True))
                self.ids = np.concatenate([self.ids, ids])
                self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        return np.fromiter(map(self.kept.__getitem__, found), np.int64, len(found))

    def _of(self, numbers: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of texts of so many units each."""
        begin = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begin
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(counts)[:-1]]) if len(counts) else []

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts in which no space is first or follows white space: a unit begins at every space."""
        split = pc.split_pattern(texts, " ")
        counts = split.value_lengths().to_numpy().astype(np.int64)
        parts = split.flatten().dictionary_encode()
        code, values = parts.indices.to_numpy(), parts.dictionary.to_numpy(zero_copy_only=False)
        first = np.zeros(len(code), bool)
        first[np.cumsum(counts) - counts] = True
        used = np.zeros((2, len(values)), bool)
        used[first.astype(np.int8), code] = True
        rest, heads = (np.flatnonzero(u) for u in used)
        numbers = self._numbers([*values[heads].tolist(), *[f" {v}" for v in values[rest].tolist()]])
        at = np.empty((2, len(values)), np.int64)
        at[1, heads], at[0, rest] = numbers[: len(heads)], numbers[len(heads) :]
        return self._of(at[first.astype(np.int8), code], counts)

    def _spaced(self, texts: list[str]) -> list[np.ndarray]:
        cut = [units(t) for t in texts]
        found = list(dict.fromkeys(u for parts in cut for u in parts))
        places = dict(zip(found, self._numbers(found).tolist(), strict=True))
        return self._of(np.array([places[u] for parts in cut for u in parts], np.int64), np.array([len(parts) for parts in cut], np.int64))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cut:
            ids, counts = self._encode(texts)
            return np.split(ids, np.cumsum(counts)[:-1]) if texts else []
        column = pa.array(texts, pa.string() if sum(map(len, texts)) < 1 << 28 else pa.large_string())
        spaced = pc.match_substring_regex(column, SPACED).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for places, ids_of in ((np.flatnonzero(~spaced), lambda at: self._plain(column.take(pa.array(at)))), (np.flatnonzero(spaced), lambda at: self._spaced([texts[k] for k in at]))):
            if len(places):
                for k, ids in zip(places, ids_of(places), strict=True):
                    out[k] = ids
        return out


def pack(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END_ID) -> DataFrame:
    """Pieces of documents: ``id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``tokens`` (packed unsigned 32-bit ids).

    ``path`` is the tokenizer file, read on the driver. ``sequence_id`` is unique over all tasks.
    """
    with open(path, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    longs = [F.lit(0).cast("long").alias(n) for n in NAMES[:-1]]
    fields = df.select(F.col(id).alias(id), *longs, F.lit(b"").alias("tokens"), F.lit(0).cast("long").alias("ids_crc32")).schema
    kind = pa.array([], pa.int64()).type

    def placed(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        data = [r[5].astype("<u4").tobytes() for r in rows]
        columns = [pa.array([r[0] for r in rows], ids)]
        for values in ([r[1] for r in rows], [len(r[5]) for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]):
            columns.append(pa.array(values, kind))
        return pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary()), pa.array([zlib.crc32(d) for d in data], kind)], names=fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, texts, ids_type, rows = Packer(length, TaskContext.get().partitionId() * TASK_SPAN), None, None, []
        for whole in batches:
            for batch in small_batches(whole):
                texts = texts or Texts(shared.value)
                ids_type = batch.column(0).type
                docs = iter(batch.column(0).to_pylist())
                for block in blocks([t or "" for t in batch.column(1).to_pylist()]):
                    for ids, doc in zip(texts(block), docs, strict=False):
                        rows.extend(packer.add(doc, np.append(ids, np.uint32(end))))
                    if rows:
                        yield placed(rows, ids_type)
                        rows = []
        rows = list(packer.close())
        if rows:
            yield placed(rows, ids_type)

    return df.select(F.col(id).alias(id), F.col(text).alias("text")).mapInArrow(run, fields)
