"""Hashes of words and of word shingles, over many texts at once."""

from __future__ import annotations

import numpy as np

_LETTERS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks for the lowest 0 to 8 bytes of a number; bytes from which on a word is hashed byte by byte.
_LOW_BYTES, LONG = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64), 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space), in order, and where each text's begin (one more at the end)."""
    return hashes_in(b" ".join([*texts, b""]), np.cumsum([len(t) + 1 for t in texts]))


def hashes_in(whole: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for texts that end before ``ends`` in one piece that ends with white space.

    Words are read by eight bytes; those of more than ``LONG`` bytes are hashed byte by byte.
    """
    data = np.frombuffer(b"".join([b" ", whole, b" " * 8]), dtype=np.uint8)
    inside = (data != 0x20) & (data - np.uint8(9) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes = mix((eight[first] & _LOW_BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _STEP)
    at, done = np.flatnonzero(lengths > 8), 8
    while len(at) and done < LONG:
        part = eight[first[at] + done] & _LOW_BYTES[np.minimum(lengths[at] - done, 8)]
        hashes[at] = mix(hashes[at] * _STEP + part)
        done += 8
        at = at[lengths[at] > done]
    if len(at):
        sizes = lengths[at]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        powers = np.multiply.accumulate(np.full(int(sizes.max()), _STEP))
        letters = _LETTERS[data[np.repeat(first[at], sizes) + place]]
        hashes[at] = mix(np.add.reduceat(letters * powers[place], begin) + sizes.astype(np.uint64))
    return hashes, np.concatenate([[0], np.searchsorted(first - 1, ends)])


def order_within(owner: np.ndarray, values: np.ndarray, owners: int, code: np.ndarray | None = None) -> np.ndarray:
    """The order by owner (below ``owners``), code (one byte) and value.

    One sort by as much of the three as a number holds, which nearly always tells values of an owner apart.
    """
    bits = max(owners.bit_length(), 1)
    lead = owner.astype(np.uint64) << np.uint64(64 - bits)
    if code is not None:
        lead |= code.astype(np.uint64) << np.uint64(56 - bits)
        bits += 8
    short = lead | values >> np.uint64(bits)
    order = np.argsort(short)
    short, ordered = short[order], values[order]
    if ((short[1:] == short[:-1]) & (ordered[1:] != ordered[:-1])).any():
        return np.lexsort((values, owner) if code is None else (values, code, owner))
    return order


def distinct(values: np.ndarray, starts: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run, and where each run then begins; with the ``codes`` of values (one byte) in the order of these first."""
    sizes = np.diff(starts)
    if not len(sizes):
        return np.empty(0, values.dtype), np.zeros(1, np.int64)
    values = values[starts[0] : starts[-1]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = values[order_within(owner, values, len(sizes), codes)]
    kept = np.ones(len(values), bool)
    kept[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[kept], np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(sizes)))]).astype(np.int64)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; fewer words than ``words`` are one shingle."""
    hashes, starts = word_hashes(texts)
    counts = np.diff(starts)
    folded = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= words:
        run = hashes[: len(hashes) - words + 1].copy()
        for k in range(1, words):
            run = mix(run * _STEP + hashes[k : len(hashes) - words + 1 + k])
        folded[: len(run)] = run
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    for text in np.flatnonzero((counts > 0) & (counts < words)):
        value = hashes[starts[text] : starts[text] + 1].copy()
        for k in range(1, counts[text]):
            value = mix(value * _STEP + hashes[starts[text] + k : starts[text] + k + 1])
        folded[starts[text]] = mix(value + np.uint64(counts[text]))[0]
    ends = np.cumsum(shingles)
    where = np.repeat(starts[:-1], shingles) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - shingles, shingles)
    return distinct(folded[where], np.concatenate([[0], ends]))


def set_numbers(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of distinct values that are not empty, and two numbers that stand for each."""
    filled = np.flatnonzero(np.diff(starts))
    if not len(filled):
        return filled, np.empty(0, np.uint64), np.empty(0, np.uint64)
    low = mix(np.add.reduceat(mix(values), starts[filled]) + np.diff(starts)[filled].astype(np.uint64))
    return filled, low, mix(np.bitwise_xor.reduceat(mix(values ^ _STEP), starts[filled]) + low)


def set_keys(values: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each run of distinct values; None for an empty one."""
    filled, low, high = set_numbers(values, starts)
    keys: list[bytes | None] = [None] * (len(starts) - 1)
    packed = np.column_stack([low, high]).astype("<u8").tobytes()
    for n, text in enumerate(filled):
        keys[text] = packed[16 * n : 16 * n + 16]
    return keys


def jaccard_counts(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two packed sorted sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return common, len(x) + len(y) - common
