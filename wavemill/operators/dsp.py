"""Stateless conditioning of a series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import refuse
from ..functions.fixed import half_up, let, longs, sat32, tdiv, total

MAX_SHIFT = 31


def input_error(x: Column) -> Column:
    """Why an operator on a series gives null."""
    return F.when(F.coalesce(F.size(x), F.lit(0)) <= 0, "EmptyInput")


def mean(x: Column) -> Column:
    """Truncated mean of an array, as BIGINT; null if it is empty."""
    return F.when(F.size(x) > 0, tdiv(total(longs(x)), F.greatest(F.size(x), F.lit(1))))


def remove_mean(x: Column) -> Column:
    """The samples less their mean; null (EmptyInput) if there are none."""
    return let(mean(x), lambda m: F.when(m.isNotNull(), F.transform(x, lambda v: sat32(v.cast("long") - m))))


def fir(x: Column, coeffs: list[int], shift: int) -> Column:
    """Causal filter from a zero state; half-up shift, then saturation."""
    refuse(not coeffs, "EmptyKernel")
    refuse(not 0 <= shift <= MAX_SHIFT, "InvalidShift")

    def of(xs: Column) -> Column:  # a look back at each sample must not compute the series again
        def at(v: Column, i: Column) -> Column:
            acc = v.cast("long") * F.lit(coeffs[0]).cast("long")
            for k, c in enumerate(coeffs[1:], 1):
                acc = acc + F.when(i >= k, F.get(xs, i - k).cast("long")).otherwise(F.lit(0).cast("long")) * F.lit(c).cast("long")
            return sat32(half_up(acc, shift))

        return F.when(F.size(xs) > 0, F.transform(xs, at))

    return let(x, of)
