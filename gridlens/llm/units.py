"""Cutting text where a byte-level tokenizer's own pattern always cuts it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: White space before a space, so that the space need not begin a new match of the pattern.
_INSIDE = re.compile(r"\s |^ ")
#: Texts are worked on in blocks of so many characters; so many units and their ids are kept by a task.
BLOCK_CHARS, KEPT_UNITS = 2_000_000, 800_000
#: Texts of that many rows at most travel to Python at once.
BATCH_ROWS = 512


def units(text: str) -> list[str]:
    """Pieces of ``text`` that add up to it, each beginning at a space that follows something else.

    There the tokenizers' pattern always starts a new match, so every unit is encoded on its own.
    """
    if not text:
        return []
    parts = text.split(" ")
    if not _INSIDE.search(text):
        return parts[:1] + [f" {p}" for p in parts[1:]]
    out, open_unit = [], parts[0]
    for part in parts[1:]:
        if open_unit and not open_unit[-1].isspace():
            out.append(open_unit)
            open_unit = f" {part}"
        else:
            open_unit = f"{open_unit} {part}"
    out.append(open_unit)
    return out


def blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``BLOCK_CHARS`` characters; a longer text is a run of its own."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def encode_texts(texts: list[str], encode_units: Callable[[list[str]], list[bytes]], kept: dict[str, bytes]) -> list[bytes]:
    """Ids of each text as packed 32-bit numbers; new units go through ``encode_units``, ``kept`` remembers them."""
    cut = [units(t) for t in texts]
    new = list(set().union(*cut).difference(kept))
    if len(kept) + len(new) > KEPT_UNITS:
        known = set().union(*cut)
        for unit in [u for u in kept if u not in known]:
            del kept[unit]
    kept.update(zip(new, encode_units(new), strict=True))
    return [b"".join([kept[u] for u in parts]) for parts in cut]


def small_batches(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
