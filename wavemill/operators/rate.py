"""Decimation: every factor-th instant stays, all channels of it together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import refuse
from .spatial import block_error


def sample_rate(hz: int) -> int | None:
    """A valid rate, or None for zero."""
    return hz if hz > 0 else None


def valid_rate(hz: Column) -> Column:
    """The rate of a column; null for zero and below."""
    return F.when(hz > 0, hz)


def decimate_error(samples: Column, channels: int) -> Column:
    """Why ``decimate_unfiltered`` gives null."""
    return block_error(samples, channels)


def decimated_frames(n: Column, factor: Column) -> Column:
    return F.when(factor <= 0, 0).otherwise(F.ceil(n / F.when(factor > 0, factor)).cast("int"))


def decimate_unfiltered(samples: Column, channels: int, factor: int) -> Column:
    refuse(channels == 0, "EmptyChannelMask")
    refuse(factor == 0, "InvalidDecimation")
    size = F.size(samples)
    return F.when((size > 0) & (size % channels == 0), F.filter(samples, lambda _, i: F.floor(i / channels) % factor == 0))


def decimate_checked(samples: Column, channels: int, factor: int, rate_hz: int, band_limit_milli_hz: int) -> Column:
    """Refuses a factor whose Nyquist rate does not exceed the declared band limit."""
    refuse(factor == 0 or rate_hz // factor == 0, "InvalidDecimation")
    refuse(rate_hz // factor * 1000 <= 2 * band_limit_milli_hz, "AliasingRisk")
    return decimate_unfiltered(samples, channels, factor)
