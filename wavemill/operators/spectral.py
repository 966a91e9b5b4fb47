"""Narrowband power by one recurrence a bin."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import refuse
from ..functions.fixed import U64_MAX, clamp, dec, dec_fdiv, let, num

COEFF_SHIFT, COEFF_MAX, LIMIT = 14, 32768, 1 << 40


def _cos_quarter(x: int) -> int:
    """Cosine of x quarter turns (Q16) in Q14; each term of the polynomial is shifted by itself."""
    x2 = x * x >> 16
    x4 = x2 * x2 >> 16
    x6 = x4 * x2 >> 16
    # The polynomial's coefficients in Q16.
    v = 65536 - (80849 * x2 >> 16) + (16625 * x4 >> 16) - (1363 * x6 >> 16)
    return max(-65536, min(65536, v)) >> 2


def _cos_turns(turns: int) -> int:
    quadrant, phase = divmod(turns % 65536, 16384)
    x = phase * 4
    value = _cos_quarter(65536 - x if quadrant % 2 else x)
    return -value if quadrant in (1, 2) else value


def goertzel_coeff_q14(freq_milli_hz: int, rate_hz: int) -> int | None:
    """Twice the cosine of the bin's angle; None for 0 and from the Nyquist frequency on."""
    if not freq_milli_hz or not rate_hz or 2 * freq_milli_hz >= 1000 * rate_hz:
        return None
    return max(-COEFF_MAX, min(COEFF_MAX, 2 * _cos_turns((freq_milli_hz << 16) // (1000 * rate_hz))))


@dataclass(frozen=True)
class Resonator:
    """The recurrence of one bin, bounded after each step; its state gives the power."""

    coeff: int
    state, output = ("s1", "s2"), "s1"

    def __post_init__(self):
        refuse(not -COEFF_MAX <= self.coeff <= COEFF_MAX, "InvalidCoefficient")

    def next(self, s, x, sat):
        new = x + (self.coeff * s["s1"] >> COEFF_SHIFT) - s["s2"]
        return {"s1": np.clip(new, -LIMIT, LIMIT) if isinstance(new, np.ndarray) else min(max(new, -LIMIT), LIMIT), "s2": s["s1"]}


def power_of(s: Column, c: Column, scale_shift: int) -> Column:
    """The power of a bin's last state, as a DECIMAL below 2**64."""
    refuse(not 0 <= scale_shift <= 31, "InvalidShift")
    a, b = (F.shiftright(s[k], scale_shift) for k in ("s1", "s2"))
    d = lambda p, q: dec(dec(p) * dec(q))
    return F.greatest(F.least(dec(dec(d(a, a) + d(b, b)) - d(F.shiftright(c * a, COEFF_SHIFT), b)), num(U64_MAX)), num(0))


def goertzel_power(x: Column, coeff: Column | int, scale_shift: int = 0) -> Column:
    """Power of a bin as a DECIMAL below 2**64; null for an empty series.

    The state is bounded after each step, before it is shifted on. The last product is taken in
    decimals, so it saturates where 64 bits would wrap.
    """
    refuse(not 0 <= scale_shift <= 31, "InvalidShift")
    if isinstance(coeff, int):
        refuse(not -COEFF_MAX <= coeff <= COEFF_MAX, "InvalidCoefficient")
        coeff = F.lit(coeff)
    c = coeff.cast("long")

    def step(s: Column, v: Column) -> Column:
        new = v.cast("long") + F.shiftright(c * s["s1"], COEFF_SHIFT) - s["s2"]
        return F.struct(clamp(new, -LIMIT, LIMIT).alias("s1"), s["s1"].alias("s2"))

    zero = F.struct(F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))
    return F.when(F.size(x) > 0, let(F.aggregate(x, zero, step), lambda s: power_of(s, c, scale_shift)))


def goertzel_bank(x: Column, coeffs: list[int], scale_shift: int = 0) -> Column:
    refuse(not coeffs, "EmptyKernel")
    return F.array(*(goertzel_power(x, c, scale_shift) for c in coeffs))


def power_ratio_permille(numerator: Column, denominator: Column) -> Column:
    """Of unsigned 64-bit DECIMALs; the numerator saturates before the division. Null over 0."""
    scaled = F.least(dec(numerator * num(1000)), num(U64_MAX))
    return F.when(denominator != 0, F.least(dec_fdiv(scaled, F.when(denominator != 0, denominator)), num(2**32 - 1)).cast("long"))
