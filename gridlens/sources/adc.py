"""Raw converter samples to voltage and current, and their smoothing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.config import (
    ADC_CURRENT_GAIN,
    ADC_NOISE_VOLTS,
    ADC_PEAK_TO_RMS,
    ADC_VOLTAGE_GAIN,
    ADC_VOLTS_PER_STEP,
    KEYS,
    ORDER,
)
from gridlens.operators.ordered import Series, ordered

# Below these levels, a smoothed signal without input is zero.
SNAP = {"voltage": 5.0, "current": 0.05}


def level(high: Column, low: Column, gain: float) -> Column:
    """Calibrated level of a window's samples, from their peak-to-peak swing."""
    swing = (high - low) * F.lit(ADC_VOLTS_PER_STEP)
    clean = F.when(swing < ADC_NOISE_VOLTS, F.lit(0.0)).otherwise(swing)
    return clean / 2 * ADC_PEAK_TO_RMS * gain


def rms_columns() -> list[Column]:
    return [
        level(F.max("raw_v"), F.min("raw_v"), ADC_VOLTAGE_GAIN).alias("voltage"),
        level(F.max("raw_i"), F.min("raw_i"), ADC_CURRENT_GAIN).alias("current"),
        F.count(F.lit(1)).alias("samples"),
    ]


def adc_parts(df: DataFrame, window_ms: int = 200, keys: Sequence[str] = KEYS) -> DataFrame:
    """What of some samples is needed to know their windows' levels once the other samples come."""
    start = (F.floor(F.col("sample_ms") / window_ms) * window_ms).alias("window_start_ms")
    ends = [f(c).alias(f"{n}_{c}") for c in ("raw_v", "raw_i") for n, f in (("high", F.max), ("low", F.min))]
    return df.groupBy(*keys, start).agg(*ends, F.count(F.lit(1)).alias("samples"))


def merge_parts(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voltage and current per device and window, from the parts of all samples."""
    return parts.groupBy(*keys, "window_start_ms").agg(
        level(F.max("high_raw_v"), F.min("low_raw_v"), ADC_VOLTAGE_GAIN).alias("voltage"),
        level(F.max("high_raw_i"), F.min("low_raw_i"), ADC_CURRENT_GAIN).alias("current"),
        F.sum("samples").alias("samples"),
    )


def adc_to_rms(df: DataFrame, window_ms: int = 200, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voltage and current per device and window of samples."""
    start = (F.floor(F.col("sample_ms") / window_ms) * window_ms).alias("window_start_ms")
    return df.groupBy(*keys, start).agg(*rms_columns())


SCAN = 32  # rows whose response to each other is one product of matrices
FIRST_PART, LAST_PART = 256, 16_384  # rows smoothed at once, after a drop to zero and at most
EACH_PART = 2_048  # rows smoothed value by value where drops follow each other closely


def _smooth_each(previous: float, x: np.ndarray, alpha: float, snap: float) -> np.ndarray:
    """Smoothing value by value, for inputs that drop to zero all the time."""
    out = np.empty(len(x))
    s = previous
    for n, value in enumerate(x.tolist()):
        s = 0.0 if value == 0.0 and s < snap else (1.0 - alpha) * s + alpha * value
        out[n] = s
    return out


def _smooth_linear(previous: float, x: np.ndarray, alpha: float) -> np.ndarray:
    """Smoothing without drops: blocks of rows on their own, then the level each of them begins with."""
    keep, rows = 1.0 - alpha, -(-len(x) // SCAN)
    powers = keep ** np.arange(1, SCAN + 1)
    apart = np.arange(SCAN)[:, None] - np.arange(SCAN)
    response = np.where(apart >= 0, alpha * keep ** np.maximum(apart, 0), 0.0)
    alone = np.concatenate([x, np.zeros(rows * SCAN - len(x))]).reshape(rows, SCAN) @ response.T
    begins, level, fade = np.empty(rows), previous, float(powers[-1])
    for n, end in enumerate(alone[:, -1].tolist()):
        begins[n] = level
        level = level * fade + end
    return (alone + begins[:, None] * powers).ravel()[: len(x)]


def smooth(previous: float, x: np.ndarray, alpha: float, snap: float) -> np.ndarray:
    """Exponential smoothing that drops to zero once the input is zero and the level small.

    Parts of the rows are smoothed as if nothing dropped; what comes before the first drop of a part stands, the
    zeros after it are zero, and smoothing starts anew from there. Parts grow while nothing drops. Sums are added up in another
    order than value by value, so a level that differs from ``snap`` by rounding alone may count as on either side.
    """
    out = np.empty(len(x))
    zero, filled = x == 0.0, np.flatnonzero(x != 0.0)
    at, part, level = 0, FIRST_PART, previous
    while at < len(x):
        end = min(at + part, len(x))
        run = _smooth_linear(level, x[at:end], alpha)
        before = np.concatenate([[level], run[:-1]])
        drops = np.flatnonzero(zero[at:end] & (before < snap))
        stands = int(drops[0]) if len(drops) else end - at
        out[at : at + stands] = run[:stands]
        if len(drops):
            resume = int(np.searchsorted(filled, at + stands))
            resume = int(filled[resume]) if resume < len(filled) else len(x)
            out[at + stands : resume] = 0.0
            level, part = 0.0, FIRST_PART
            if resume - at < FIRST_PART // 4:
                end = min(resume + EACH_PART, len(x))
                out[resume:end] = _smooth_each(0.0, x[resume:end], alpha, snap)
                resume, level = end, float(out[end - 1])
            at = resume
        else:
            at, part, level = end, min(2 * part, LAST_PART), float(run[-1])
    return out


def transfer(x: np.ndarray, alpha: float, snap: float) -> list[tuple[float, float, float]]:
    """How a run of inputs maps the level before it to the level after it.

    The map is piecewise linear: for a level from ``start`` up to the next piece's, the result
    is ``gain * level + offset``. Smoothing scales every piece; a zero input also sends the
    levels that end up under ``snap`` to zero, which splits the piece they are in.
    """
    keep = 1.0 - alpha
    pieces = [(0.0, 1.0, 0.0)]
    done = 0
    for zero in [*np.flatnonzero(x == 0.0).tolist(), len(x)]:
        if zero > done:  # all values between two zeros scale the pieces at once
            run = x[done:zero]
            fade = keep ** len(run)
            reached = alpha * float(run @ keep ** np.arange(len(run) - 1, -1, -1.0))
            pieces = [(lo, gain * fade, offset * fade + reached) for lo, gain, offset in pieces]
        done = zero + 1
        if zero == len(x):
            break
        changed: list[tuple[float, float, float]] = []
        for n, (lo, gain, offset) in enumerate(pieces):
            end = pieces[n + 1][0] if n + 1 < len(pieces) else float("inf")
            border = (snap - offset) / gain if gain > 0 else (float("inf") if offset < snap else lo)
            border = min(max(border, lo), end)
            if border > lo and not (changed and changed[-1][1:] == (0.0, 0.0)):
                changed.append((lo, 0.0, 0.0))
            if border < end:
                changed.append((border, gain * keep, offset * keep))
        pieces = changed
    return pieces


def after(level: float, pieces: Sequence) -> float:
    """The level that ``transfer`` pieces lead to from ``level``."""
    at = max(n for n, piece in enumerate(pieces) if piece[0] <= level)
    _, gain, offset = pieces[at]
    return gain * level + offset


def ewma_snap(
    df: DataFrame,
    alpha: float = 0.2,
    signals: dict[str, float] | None = None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    **split,
) -> DataFrame:
    """Smoothed signals of each device as ``smooth_<signal>``.

    The level passes from batch to batch of the sorted rows. A device that is too large for one
    task is smoothed chunk by chunk: each chunk is first reduced to the map from the level
    before it to the level after it, and following these maps along the chunks gives the level
    each chunk begins with.
    """
    signals = signals or SNAP
    series = ordered(df, keys, order, **split)
    rows = series.sorted()
    if series.split:
        begins = _chunk_levels(series, signals, alpha)
        rows = series.df.join(begins, list(series.part)).sortWithinPartitions(*series.part, *series.order)
    else:
        rows = rows.withColumns({f"_begin_{s}": F.lit(0.0) for s in signals})
    added = [T.StructField(f"smooth_{s}", T.DoubleType()) for s in signals]
    kept = [f for f in rows.schema.fields if not f.name.startswith("_")]
    part = list(series.part)

    def smooth_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, level = None, {}
        for batch in batches:
            ids = list(zip(*(batch[c].tolist() for c in part)))
            starts = [0] + [n for n in range(1, len(ids)) if ids[n] != ids[n - 1]]
            out = {f.name: np.empty(len(batch)) for f in added}
            for begin, end in zip(starts, starts[1:] + [len(ids)]):
                fresh = ids[begin] != current
                current = ids[begin]
                for s, snap in signals.items():
                    before = float(batch[f"_begin_{s}"].iloc[begin]) if fresh else level[s]
                    run = smooth(before, batch[s].to_numpy(float)[begin:end], alpha, snap)
                    out[f"smooth_{s}"][begin:end] = run
                    level[s] = run[-1]
            yield batch[[f.name for f in kept]].assign(**out)

    return rows.mapInPandas(smooth_sorted, T.StructType(kept + added))


def _chunk_levels(series: Series, signals: dict[str, float], alpha: float) -> DataFrame:
    """Level of each signal at the beginning of each chunk."""
    keys, order_by = list(series.keys), list(series.order)
    chunk_id = [series.df.schema[c] for c in series.part]
    maps = T.StructType(
        chunk_id + [T.StructField(f"_map_{s}", T.ArrayType(T.ArrayType(T.DoubleType()))) for s in signals]
    )
    levels = T.StructType(chunk_id + [T.StructField(f"_begin_{s}", T.DoubleType()) for s in signals])
    part = list(series.part)

    def reduce_chunk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order_by)
        row = {c: [group[c].iloc[0]] for c in part}
        for s, snap in signals.items():
            row[f"_map_{s}"] = [[list(p) for p in transfer(group[s].to_numpy(float), alpha, snap)]]
        return pd.DataFrame(row)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, level = None, {}
        for batch in batches:
            out = batch[part].copy()
            begins = {s: np.zeros(len(batch)) for s in signals}
            for n, key in enumerate(zip(*(batch[k] for k in keys))):
                if key != device:
                    device, level = key, dict.fromkeys(signals, 0.0)
                for s in signals:
                    begins[s][n] = level[s]
                    level[s] = after(level[s], batch[f"_map_{s}"].iloc[n])
            for s in signals:
                out[f"_begin_{s}"] = begins[s]
            yield out

    chunks = series.df.groupBy(*part).applyInPandas(reduce_chunk, maps)
    return chunks.repartition(*keys).sortWithinPartitions(*part).mapInPandas(follow, levels)
