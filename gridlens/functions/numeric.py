"""Rounding, safe division and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x, digits: int = 4) -> Column:
    """Round half up at ``digits`` decimals.

    The small push before ``floor`` makes decimal ties (1.005) go up whatever their binary
    form is. Rounding half to even differs on exact ties only.
    """
    scale = 10**digits
    if isinstance(x, str):  # the same in one call, for tables with many columns
        return F.expr(f"CAST(floor(`{x}` * {scale} + 0.500001D) AS DOUBLE) / {scale}")
    return F.floor(col(x) * F.lit(scale) + F.lit(0.500001)).cast("double") / F.lit(scale)


def sdiv(a, b, default: float | None = 0.0) -> Column:
    """``a / b`` with ``default`` where the quotient is undefined."""
    q = F.try_divide(col(a), col(b))
    return q if default is None else F.coalesce(q, F.lit(default))


def clamp(x, lo: float, hi: float) -> Column:
    """``x`` within bounds; nulls stay, which ``least`` and ``greatest`` alone would skip."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(x))))


def sanitize(x, fallback: float, lo: float, hi: float) -> Column:
    """Parse as a number and clamp it; anything not finite becomes ``fallback``."""
    n = col(x).cast("string").try_cast("double")
    bad = n.isNull() | F.isnan(n) | (F.abs(n) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(fallback))).otherwise(clamp(n, lo, hi))


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def fixed(x, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", half_up(x, digits))
