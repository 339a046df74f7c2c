"""Number helpers whose rules differ from Spark's defaults."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Nearest integer, halves to even (F.round rounds halves up)."""
    return F.rint(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column) -> Column:
    """x, NULL where it is NaN or infinite (Spark's max and avg would let NaN win)."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def half_away(v: np.ndarray, digits: int) -> np.ndarray:
    """v rounded to digits, halves away from zero, by the scaled number as DuckDB does; never a negative zero. Infinite numbers and NaN stay."""
    scaled = v * 10.0**digits
    whole = np.trunc(scaled)
    with np.errstate(invalid="ignore"):
        up = np.abs(scaled - whole) >= 0.5
    return np.where(np.isfinite(scaled), (whole + np.where(up, np.copysign(1.0, scaled), 0.0)) / 10.0**digits, v) + 0.0
