"""Functions that Spark lacks, as Column arithmetic."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwise.functions.num import half_even

#: The error function is 1 to a double's precision beyond this; below, a polynomial serves each piece.
_END, _PIECES, _DEGREE = 6.0, 24, 13


@lru_cache(maxsize=1)
def _erf_pieces() -> list[list[float]]:
    """Highest coefficients first: polynomials in u from -1 to 1 that meet erf in the Chebyshev points of each piece."""
    width = _END / _PIECES
    out = []
    for k in range(_PIECES):
        of = np.vectorize(lambda u, k=k: math.erf((k + (u + 1) / 2) * width))
        out.append(np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(of, _DEGREE))[::-1].tolist())
    return out


def erf(x: Column) -> Column:
    """The error function to 1e-14; NaN stays, an infinite x gives 1 or -1."""
    a, scale = F.abs(x), _PIECES / _END
    table = F.array(*[F.array(*[F.lit(c) for c in piece]) for piece in _erf_pieces()])
    piece = F.least(F.floor(a * scale), F.lit(_PIECES - 1)).cast("int")
    u = (a * scale - piece) * 2 - 1
    inside = F.transform(F.array(F.struct(piece.alias("piece"), u.alias("u"))), lambda at: F.aggregate(F.get(table, at["piece"]), F.lit(0.0), lambda acc, c: acc * at["u"] + c))[0]
    return F.when(F.isnan(x), x).when(a >= _END, F.signum(x)).otherwise(F.signum(x) * inside)


def gelu(x: Column) -> Column:
    """x times the normal distribution function of x."""
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def half_precision(x: Column) -> Column:
    """The nearest number of 11 binary digits, halves to even, as IEEE half precision has it: subnormal below 2^-14, infinite from 65,520 on."""
    x = x.cast("double")
    a = F.abs(x)
    rough = F.floor(F.log2(a))  # may miss by one beside a power of two
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.greatest(F.when(power(rough) > a, rough - 1).when(power(rough + 1) <= a, rough + 1).otherwise(rough), F.lit(-14))
    step = power(exponent - 10)
    near = half_even(a / step) * step
    return F.when(F.isnan(x) | (a == 0) | x.isNull(), x).when(a >= 65520.0, F.signum(x) * float("inf")).otherwise(F.signum(x) * near)
