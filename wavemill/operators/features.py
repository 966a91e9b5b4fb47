"""Integer features of a series; null (EmptyInput) for an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import dec, dec_fdiv, isqrt, let, log2_q16, num, tdiv, total
from .dsp import mean


def variance(x: Column) -> Column:
    """Mean square deviation from the truncated mean, rounded down, as a DECIMAL."""

    def around(m: Column) -> Column:
        squares = F.transform(x, lambda v: dec(dec(v.cast("long") - m) * dec(v.cast("long") - m)))
        return let(total(squares, num(0)), lambda s: dec_fdiv(s, dec(F.size(x))))

    return F.when(F.size(x) > 0, let(mean(x), around))


def log_variance_q16(x: Column) -> Column:
    return let(variance(x), lambda v: F.when(v.isNotNull(), log2_q16(v)))


def rms(x: Column) -> Column:
    """Root of the variance, so without the mean."""
    return let(variance(x), lambda v: F.when(v.isNotNull(), isqrt(v).cast("long")))


def abs_mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, tdiv(total(F.transform(x, lambda v: F.abs(v.cast("long")))), F.greatest(F.size(x), F.lit(1))))


def zero_crossings(x: Column) -> Column:
    """Strict changes of sign between neighbours; a zero breaks them. None in an empty series."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    flips = F.zip_with(F.slice(x, F.lit(2), n), F.slice(x, F.lit(1), n), lambda a, b: ((a < 0) & (b > 0)) | ((a > 0) & (b < 0)))
    return F.size(F.filter(flips, lambda f: f))


def feature_vector(*values: Column) -> Column:
    """Features as floats, for other systems; off the integer path."""
    return F.array(*(v.cast("float") for v in values))
