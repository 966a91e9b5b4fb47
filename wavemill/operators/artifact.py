"""Screening for artifacts. Findings are bits of one integer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import refuse
from ..functions.fixed import let, longs, tdiv, total
from ..sources.frames import column
from .spatial import block_error

ADC24_MAX, ADC24_MIN = 8388607, -8388608
SATURATED, AMPLITUDE, SLEW, FLATLINE, DRIFT = 1, 2, 4, 8, 16
DISQUALIFYING = SATURATED | SLEW | FLATLINE
MAX_FRAMES = 4096


@dataclass(frozen=True)
class ScreenLimits:
    """A limit of zero switches its test off, but for the amplitude, which must be positive."""

    amplitude: int = 5369
    slew: int = 2237
    flat_range: int = 45
    drift: int = 3356

    @staticmethod
    def amplitude_only(amplitude: int) -> ScreenLimits:
        return ScreenLimits(amplitude, 0, 0, 0)


def _rail(x: Column) -> Column:
    return F.exists(x, lambda v: (v >= ADC24_MAX) | (v <= ADC24_MIN))


def artifact_scan(x: Column, threshold: int) -> Column:
    """clean, amplitude_exceeded or saturated, which dominates; an empty array is clean."""
    refuse(threshold <= 0, "InvalidThreshold")
    return F.when(_rail(x), "saturated").when(F.exists(x, lambda v: (v > threshold) | (v < -threshold)), "amplitude_exceeded").when(x.isNotNull(), "clean")


def artifact_screen(x: Column, limits: ScreenLimits = ScreenLimits()) -> Column:
    """All findings of a series; null (EmptyInput) if it is empty."""
    refuse(limits.amplitude <= 0, "InvalidThreshold")
    bit = lambda test, value: F.when(test, value).otherwise(0)

    def of(x: Column) -> Column:
        n = F.size(x)
        quarter = F.floor(n / 4).cast("int")
        out = bit(_rail(x), SATURATED) + bit(F.exists(x, lambda v: (v > limits.amplitude) | (v < -limits.amplitude)), AMPLITUDE)
        if limits.slew > 0:
            jumps = F.zip_with(F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a.cast("long") - b) > limits.slew)
            out = out + bit(F.exists(jumps, lambda j: j), SLEW)
        if limits.flat_range > 0:
            out = out + bit(F.array_max(x).cast("long") - F.array_min(x) <= limits.flat_range, FLATLINE)
        if limits.drift > 0:
            part = lambda start: tdiv(total(longs(F.slice(x, start, quarter))), F.greatest(quarter, F.lit(1)))
            out = out + bit((quarter > 0) & (F.abs(part(n - quarter + 1) - part(F.lit(1))) > limits.drift), DRIFT)
        return F.when(n > 0, out)

    return let(x, of)


def artifact_screen_block(samples: Column, channels: int, limits: ScreenLimits = ScreenLimits(), max_frames: int = MAX_FRAMES) -> Column:
    """Findings by channel of an interleaved block; null if it is misshapen or too long."""
    refuse(channels == 0, "EmptyChannelMask")
    size = F.size(samples)
    ok = (size > 0) & (size % channels == 0) & (size <= channels * max_frames)
    each = [let(column(samples, channels, c), lambda x: artifact_screen(x, limits)) for c in range(channels)]
    return F.when(ok, F.array(*each))


def block_screen_error(samples: Column, channels: int, max_frames: int = MAX_FRAMES) -> Column:
    """Why ``artifact_screen_block`` gives null: no channels, a misshapen block, or one too long."""
    return F.coalesce(block_error(samples, channels), F.when(F.size(samples) > channels * max_frames, "WindowTooLarge"))


def disqualifying(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(DISQUALIFYING)) != 0


def has(bits: Column, flag: int) -> Column:
    return bits.bitwiseAND(F.lit(flag)) != 0


def from_bits(bits: Column) -> Column:
    """A report of any integer: bits that name no finding are dropped."""
    return bits.bitwiseAND(F.lit(SATURATED | AMPLITUDE | SLEW | FLATLINE | DRIFT))


def with_flag(bits: Column, flag: int) -> Column:
    return bits.bitwiseOR(F.lit(flag))


def clean() -> Column:
    return F.lit(0)


def is_clean(bits: Column) -> Column:
    return bits == 0
