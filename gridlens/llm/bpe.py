"""Byte-level BPE with the merges done by recursive DuckDB queries inside each task.

A rank file lists tokens as bytes; two neighbouring tokens may be merged if their concatenation is
a token, whose rank is the merge's. Each match of the pattern is a word; words that a task has not
met yet become rows (word, list of tokens). One step of the recursive query joins neighbouring
tokens with the merge table and contracts each word's leftmost pair of least rank; words without a
pair are done. Texts are then put together from their words' ids. Decoding joins positions with the
vocabulary and aggregates the bytes in their order.

Ids are columns of packed little-endian unsigned 32-bit numbers, the usual layout of token files.

Cases: null and empty texts have no ids and decode to nothing; null ids decode to null; an id outside the
vocabulary is an error. A word of more than ``LONG_WORD`` bytes (no white space, one kind of character) would
need as many steps as it has bytes; it is contracted by a heap over the same merges instead.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.units import KEPT_UNITS, blocks, encode_texts, small_batches

#: Words of that many bytes at most go through the recursive query, so many bytes of them at once.
LONG_WORD, QUERY_BYTES = 2_000, 4_000_000
#: Ids that are decoded at once.
DECODE_IDS = 500_000
#: Memory of a task's DuckDB.
DUCKDB_MEMORY = "256MB"

CONTRACT = """
WITH RECURSIVE step(word, tokens, done) AS (
    SELECT word, list(token ORDER BY pos), false FROM letters GROUP BY word
  UNION ALL (
    WITH open AS (
      SELECT word, tokens FROM step WHERE NOT done
    ), pairs AS (
      SELECT word, unnest(range(1, len(tokens))) AS place, unnest(tokens[:-2]) * 4294967296 + unnest(tokens[2:]) AS pair FROM open
    ), best AS (
      SELECT word, min(merged * 4294967296 + place) AS least FROM pairs JOIN merges USING (pair) GROUP BY word
    )
    SELECT o.word, CASE WHEN b.word IS NULL THEN o.tokens
      ELSE o.tokens[:b.least % 4294967296 - 1] || [b.least // 4294967296] || o.tokens[b.least % 4294967296 + 2:] END, b.word IS NULL
    FROM open o LEFT JOIN best b ON o.word = b.word
  )
)
SELECT word, tokens FROM step WHERE done ORDER BY word
"""
DECODE = """
SELECT text, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM ids JOIN vocabulary USING (token) GROUP BY text
"""


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token and rank per line) by rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def merge_rows(tokens: list[bytes]) -> np.ndarray:
    """All (first, second, merged) such that two tokens make a third."""
    ids = {t: i for i, t in enumerate(tokens) if t}
    rows = []
    for token, i in ids.items():
        for cut in range(1, len(token)):
            first, second = ids.get(token[:cut]), ids.get(token[cut:])
            if first is not None and second is not None:
                rows.append((first, second, i))
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def _connect() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "preserve_insertion_order": False})


class Encoder:
    """A task's DuckDB with the merge table, and the words it has met."""

    def __init__(self, tokens: list[bytes], merges: np.ndarray, pattern: str):
        self.pattern = regex.compile(pattern)
        self.letter = np.zeros(256, dtype=np.int64)
        for i, token in enumerate(tokens):
            if len(token) == 1:
                self.letter[token[0]] = i
        self.merges = merges
        self.by_pair: dict[tuple[int, int], int] | None = None
        self.kept: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.db = _connect()
        table = pa.table({"pair": (merges[:, 0] << 32) + merges[:, 1], "merged": merges[:, 2]})
        self.db.register("rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM rows")
        self.db.unregister("rows")

    def _query(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        letters = pa.table(
            {
                "word": np.repeat(np.arange(len(words)), sizes),
                "pos": np.arange(ends[-1]) - np.repeat(ends - sizes, sizes),
                "token": self.letter[np.frombuffer(b"".join(words), dtype=np.uint8)],
            }
        )
        self.db.register("letters", letters)
        tokens = self.db.sql(CONTRACT).to_arrow_table()["tokens"].combine_chunks()
        self.db.unregister("letters")
        ids = tokens.flatten().to_numpy().astype("<u4")
        at = np.cumsum([0, *tokens.value_lengths().to_pylist()])
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def _long(self, word: bytes) -> bytes:
        """Same merges for one long word: a heap of pairs by rank and place over a linked list."""
        if self.by_pair is None:
            self.by_pair = {(int(a), int(b)): int(m) for a, b, m in self.merges}
        ids = self.letter[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))

        def pair(i: int) -> tuple | None:
            j = after[i]
            merged = self.by_pair.get((ids[i], ids[j])) if j < len(ids) else None
            return None if merged is None else (merged, i, ids[i], ids[j])

        heap = [p for p in map(pair, range(len(ids))) if p]
        heapq.heapify(heap)
        while heap:
            merged, i, first, second = heapq.heappop(heap)
            j = after[i]
            if ids[i] != first or j >= len(ids) or ids[j] != second:
                continue
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and (p := pair(at)):
                    heapq.heappush(heap, p)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        out, asked, size = {}, [], 0
        for word in words:
            data = word.encode()
            if len(data) > LONG_WORD:
                out[word] = self._long(data)
                continue
            asked.append((word, data))
            size += len(data)
            if size > QUERY_BYTES:
                out.update(zip([w for w, _ in asked], self._query([d for _, d in asked]), strict=True))
                asked, size = [], 0
        if asked:
            out.update(zip([w for w, _ in asked], self._query([d for _, d in asked]), strict=True))
        return [out[w] for w in words]

    def units(self, units: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(u) for u in units]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > KEPT_UNITS:
            self.known.clear()
            new = list(set().union(*cut))
        self.known.update(zip(new, self.words(new), strict=True))
        return [b"".join([self.known[w] for w in parts]) for parts in cut]

    def texts(self, texts: list[str]) -> list[bytes]:
        return encode_texts(texts, self.units, self.kept)


def encode(df: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``id``, ``ids`` (packed) and ``n_tokens`` of every row; ``path`` is the rank file, read on the driver."""
    tokens = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast((tokens, merge_rows(tokens), pattern))
    fields = df.select(F.col(id).alias(id), F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for batch in small_batches(whole):
                encoder = encoder or Encoder(*shared.value)
                at = 0
                for block in blocks([t or "" for t in batch.column(1).to_pylist()]):
                    ids = encoder.texts(block)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(block)), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())],
                        names=[id, "ids", "n_tokens"],
                    )
                    at += len(block)

    return df.select(F.col(id).alias(id), F.col(text).alias("text")).mapInArrow(run, fields)


class Decoder:
    """A task's DuckDB with the vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.db = _connect()
        self.db.register("rows", pa.table({"token": np.arange(self.size, dtype=np.int64), "hex": [t.hex().upper() for t in tokens]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM rows")
        self.db.unregister("rows")

    def __call__(self, packed: list[bytes]) -> list[bytes]:
        counts = np.array([len(p) // 4 for p in packed])
        ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64)
        if len(ids) and ids.max() >= self.size:
            raise ValueError(f"id {ids.max()} is not in the vocabulary")
        self.db.register("ids", pa.table({"text": np.repeat(np.arange(len(packed)), counts), "pos": np.arange(len(ids)), "token": ids}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(packed)
        for at, data in zip(found["text"].to_pylist(), found["bytes"].to_pylist(), strict=True):
            out[at] = data
        return out


def decode(df: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Columns ``id``, ``ids`` and ``decoded`` (bytes) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    fields = df.select(F.col(id).alias(id), F.col(ids).alias("ids"), F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for whole in batches:
            packed = whole.column(1).to_pylist()
            at = 0
            while at < len(packed):
                decoder = decoder or Decoder(shared.value)
                end, size = at, 0
                while end < len(packed) and (end == at or size + len(packed[end] or b"") <= 4 * DECODE_IDS):
                    size += len(packed[end] or b"")
                    end += 1
                found = decoder([p or b"" for p in packed[at:end]])
                part = whole.slice(at, end - at)
                found = [None if p is None else d for p, d in zip(packed[at:end], found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=[id, "ids", "decoded"])
                at = end

    return df.select(F.col(id).alias(id), F.col(ids).alias("ids")).mapInArrow(run, fields)
