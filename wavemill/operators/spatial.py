"""Operators across the channels of an instant, on interleaved frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import refuse
from ..functions.fixed import let, sat32, tdiv, total

SHIFT, ONE = 16, 1 << 16


def block_error(samples: Column, channels: int) -> Column:
    size = F.coalesce(F.size(samples), F.lit(0))
    bad = F.lit(True) if channels == 0 else (size <= 0) | (size % channels != 0)
    return F.when(F.lit(channels == 0), "EmptyChannelMask").when(bad, "SampleLengthMismatch")


def instants(samples: Column, channels: int) -> Column:
    """The samples as an array of instants, as BIGINT; null for a block that is no whole number of them."""
    size = F.size(samples)
    at = F.sequence(F.lit(0), F.floor(size / channels).cast("int") - 1)
    rows = F.transform(at, lambda t: F.array(*(F.get(samples, t * channels + c).cast("long") for c in range(channels))))
    return F.when((size > 0) & (size % channels == 0), rows)


def _each(samples: Column, channels: int, reference) -> Column:
    """Subtract ``reference(instant)`` from every sample of the instant."""
    rows = instants(samples, channels)
    return F.flatten(F.transform(rows, lambda row: let(reference(row), lambda r: F.transform(row, lambda v: sat32(v - r)))))


def common_average(samples: Column, channels: int) -> Column:
    refuse(channels == 0, "EmptyChannelMask")
    return _each(samples, channels, lambda row: tdiv(total(row), F.lit(channels)))


def single_reference(samples: Column, channels: int, col: int) -> Column:
    """``col`` counts enabled channels."""
    refuse(channels == 0, "EmptyChannelMask")
    refuse(not 0 <= col < channels, "DimensionMismatch")
    return _each(samples, channels, lambda row: F.get(row, F.lit(col)))


def average_reference(samples: Column, channels: int, cols: list[int]) -> Column:
    """A column that is named twice counts twice."""
    refuse(channels == 0 or not cols, "EmptyChannelMask")
    refuse(any(not 0 <= c < channels for c in cols), "DimensionMismatch")
    return _each(samples, channels, lambda row: tdiv(sum((F.get(row, F.lit(c)) for c in cols[1:]), F.get(row, F.lit(cols[0]))), F.lit(len(cols))))


def identity_weights(outputs: int, inputs: int) -> list[list[int]]:
    return [[ONE if i == o else 0 for i in range(inputs)] for o in range(outputs)]


def common_average_weights(inputs: int) -> list[list[int]]:
    share = ONE // inputs
    return [[(ONE if i == o else 0) - share for i in range(inputs)] for o in range(inputs)]


def spatial_filter(samples: Column, weights: list[list[int]]) -> Column:
    """Q16 matrix times each instant: floor shift, then saturation. Fewer rows than columns reduce."""
    refuse(not weights or not weights[0], "EmptyChannelMask")
    inputs = len(weights[0])

    def product(row: Column, w: list[int]) -> Column:
        acc = F.get(row, F.lit(0)) * F.lit(w[0]).cast("long")
        for i in range(1, inputs):
            acc = acc + F.get(row, F.lit(i)) * F.lit(w[i]).cast("long")
        return sat32(F.shiftright(acc, SHIFT))

    return F.flatten(F.transform(instants(samples, inputs), lambda row: F.array(*(product(row, w) for w in weights))))


def remove_baseline(samples: Column, channels: int, baseline: int) -> Column:
    """Subtract each channel's truncated mean over the first instants; null if there are too few."""
    refuse(channels == 0, "EmptyChannelMask")
    refuse(baseline == 0, "InvalidWindow")
    size = F.size(samples)
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda c: tdiv(F.aggregate(F.sequence(F.lit(0), F.lit(baseline - 1)), F.lit(0).cast("long"), lambda a, t: a + F.get(samples, t * channels + c)), F.lit(baseline)),
    )
    fits = (size > 0) & (size % channels == 0) & (size >= channels * baseline)
    return F.when(fits, let(sums, lambda base: F.transform(samples, lambda v, i: sat32(v.cast("long") - F.get(base, i % channels)))))


def baseline_error(samples: Column, channels: int, baseline: int) -> Column:
    """Why ``remove_baseline`` gives null: a misshapen block, or fewer instants than the baseline."""
    return F.coalesce(block_error(samples, channels), F.when(F.size(samples) < channels * baseline, "WindowTooLarge"))
