"""Per-device state over streams.

Each operator here keeps a small state per device. A device's rows of one micro-batch meet in
one task, which is what an order-dependent state needs; the reader's trigger limit bounds them.
Within a micro-batch, rows are taken in order of time. Across micro-batches, arrival decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridlens.config import DEFAULTS, ORDER, SIGNALS, Settings
from gridlens.operators.features import FEATURE_NAMES, window_matrix
from gridlens.sources.adc import SNAP, smooth

Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


def per_device(
    df: DataFrame, step: Step, added: Sequence[tuple[str, str]], state: str, order: Sequence[str] = ORDER
) -> DataFrame:
    """Run ``step(rows, state) -> (rows out, state)`` per device; ``added`` columns follow those of ``df``."""
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(", ".join(" ".join(a) for a in added)).fields if added else df.schema.fields)
    names, order = [f.name for f in schema.fields], list(order)

    def update(key: tuple, batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, ignore_index=True)
        out, after = step(rows, held.get if held.exists else None)
        held.update(after)
        yield out[names]

    return df.groupBy("device_id").applyInPandasWithState(
        update, schema, state, "append", GroupStateTimeout.NoTimeout
    )


STATS_ADDED = [
    ("pos", "BIGINT"),
    ("energy_kwh", "DOUBLE"),
    *[(f"{s}_{n}", "DOUBLE") for s in SIGNALS for n in ("min", "avg", "max")],
    *[x for s in SIGNALS for x in ((f"peak_{s}", "DOUBLE"), (f"peak_{s}_us", "BIGINT"))],
    ("start_us", "BIGINT"),
]
STATS_STATE = (
    "pos BIGINT, last_us BIGINT, start_us BIGINT, kwh DOUBLE, sums ARRAY<DOUBLE>, lows ARRAY<DOUBLE>, highs ARRAY<DOUBLE>,"
    "peaks ARRAY<DOUBLE>, peak_us ARRAY<BIGINT>"
)


def _stats_step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
    n = len(rows)
    us = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    inf = float("inf")
    pos, last, start, kwh, sums, lows, highs, peaks, peak_us = held or (
        0, int(us[0]), int(us[0]), 0.0, [0.0] * 3, [inf] * 3, [-inf] * 3, [0.0] * 3, [-1] * 3
    )
    count = pos + np.arange(1, n + 1)
    # A reading that arrives late adds no time.
    clock = np.maximum.accumulate(np.maximum(us, last))
    seconds = np.diff(clock, prepend=last) / 1e6
    energy = kwh + np.cumsum(rows["power"].to_numpy() / 1000 * (seconds / 3600))
    out = {"pos": count, "energy_kwh": energy, "start_us": np.full(n, start)}
    after: list[list] = [[], [], [], [], []]
    for k, s in enumerate(SIGNALS):
        x = rows[s].to_numpy()
        total = sums[k] + np.cumsum(x)
        low = np.minimum.accumulate(np.minimum(x, lows[k]))
        high = np.maximum.accumulate(np.maximum(x, highs[k]))
        top = np.maximum.accumulate(np.maximum(x, peaks[k]))
        rose = top > np.concatenate([[peaks[k]], top[:-1]])
        first = np.maximum.accumulate(np.where(rose, np.arange(n), -1))
        when = np.where(first >= 0, us[np.maximum(first, 0)], peak_us[k])
        out |= {f"{s}_min": low, f"{s}_avg": total / count, f"{s}_max": high, f"peak_{s}": top, f"peak_{s}_us": when}
        for kept, values in zip(after, (total, low, high, top, when)):
            kept.append(values[-1].item())
    state = (int(count[-1]), int(clock[-1]), start, float(energy[-1]), *after)
    return rows.assign(**out), state


def running_stats(df: DataFrame) -> DataFrame:
    """Each reading with its number, the energy, spread and peaks of its device so far.

    Peak times and the first time are microseconds since 1970, -1 before any peak.
    """
    return per_device(df, _stats_step, STATS_ADDED, STATS_STATE)


def window_features(
    df: DataFrame, names: Sequence[str] = tuple(FEATURE_NAMES), settings: Settings = DEFAULTS
) -> DataFrame:
    """Features of the window that ends at each reading, once the device has a full one."""
    size, names = settings.window, list(names)

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        before = held or ([], [], [])
        signals = [np.concatenate([np.asarray(b, dtype=float), rows[s].to_numpy(float)]) for b, s in zip(before, SIGNALS)]
        state = tuple(x[1 - size :].tolist() for x in signals)
        if len(signals[0]) < size:
            return rows.head(0).reindex(columns=[*rows.columns, *names]), state
        full = [np.lib.stride_tricks.sliding_window_view(x, size) for x in signals]
        out = rows.tail(len(full[0])).reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(window_matrix(*full, names, settings))], axis=1), state

    kept = ", ".join(f"{s} ARRAY<DOUBLE>" for s in SIGNALS)
    return per_device(df, step, [(n, "DOUBLE") for n in names], kept)


def ewma(df: DataFrame, alpha: float = 0.2, signals: dict[str, float] | None = None) -> DataFrame:
    """Smoothed signals as ``smooth_<signal>``."""
    signals = signals or SNAP

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        levels = held or (0.0,) * len(signals)
        runs = [smooth(b, rows[s].to_numpy(float), alpha, snap) for b, (s, snap) in zip(levels, signals.items())]
        out = rows.assign(**{f"smooth_{s}": run for s, run in zip(signals, runs)})
        return out, tuple(float(run[-1]) for run in runs)

    added = [(f"smooth_{s}", "DOUBLE") for s in signals]
    return per_device(df, step, added, ", ".join(f"{s} DOUBLE" for s in signals))


def drop_repeated(df: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Drop a reading with the timestamp of the one that arrived just before it."""

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        us = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        before = np.concatenate([[held[0] if held else us[0] - 1], us[:-1]])
        return rows[us != before], (int(us[-1]),)

    return per_device(df, step, [], "last_us BIGINT", order)
