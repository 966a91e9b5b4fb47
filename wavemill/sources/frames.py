"""Frames: validated blocks of interleaved samples, and the forms that operators read.

A *frame* is one row with ``samples`` (all channels of an instant, then the next instant). A
*series* is one row for each channel with the samples in time order. Operators are expressions
over these arrays, so a plan needs no shuffle beyond the one that builds a series from samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed

RATES = {"HZ_250": 250, "HZ_500": 500, "HZ_1000": 1000}

FRAME = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp_us", T.LongType()),
        T.StructField("rate_hz", T.LongType()),
        T.StructField("channel_mask", T.IntegerType()),
        T.StructField("samples", T.ArrayType(T.IntegerType())),
    ]
)


# --- channel masks -------------------------------------------------------------------------------


def first_n(n: Column) -> Column:
    return F.when(n <= 0, 0).when(n >= 16, 65535).otherwise((F.pow(F.lit(2.0), n) - 1).cast("int"))


def enabled_count(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def is_enabled(mask: Column, channel: Column) -> Column:
    bit = F.call_function("shiftright", mask, F.least(channel, F.lit(31)).cast("int")).bitwiseAND(F.lit(1))
    return (channel >= 0) & (channel < 16) & (bit == 1)


def column_of(mask: Column, channel: Column) -> Column:
    """The place of a channel among the enabled ones; null if it isn't."""
    below = (F.pow(F.lit(2.0), F.least(channel, F.lit(16))) - 1).cast("int")
    return F.when(is_enabled(mask, channel), F.bit_count(mask.bitwiseAND(below)).cast("int"))


def channels(mask: Column) -> Column:
    """The enabled channels in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(15)), lambda c: F.call_function("shiftright", mask, c).bitwiseAND(F.lit(1)) == 1)


def channel_at(mask: Column, col: Column) -> Column:
    """The channel of a column, the inverse of ``column_of``; null past the last one."""
    return F.when(col >= 0, F.get(channels(mask), col))


# --- frames --------------------------------------------------------------------------------------


def frame_error(mask: Column, samples: Column) -> Column:
    n = enabled_count(mask)
    size = F.coalesce(F.size(samples), F.lit(0))
    return F.when(n == 0, "EmptyChannelMask").when((size <= 0) | (size % F.greatest(n, F.lit(1)) != 0), "SampleLengthMismatch")


def validate_frames(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds samples_per_channel and error (null for good frames); ``strict`` raises instead."""
    n = enabled_count(F.col("channel_mask"))
    out = df.withColumn("error", frame_error(F.col("channel_mask"), F.col("samples")))
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("string"))
    return out.withColumn("samples_per_channel", F.when(F.col("error").isNull(), F.floor(F.size("samples") / n).cast("int")))


def sample_at(samples: Column, n: Column, t: Column, col: Column) -> Column:
    """The sample of an instant and column; null outside of the frame."""
    return F.when((col >= 0) & (col < n) & (t >= 0), F.get(samples, (t * n + col).cast("int")))


def checksum(seq: Column, timestamp_us: Column, rate_hz: Column, mask: Column, spc: Column, samples: Column) -> Column:
    """Digest of a frame's header and samples, as a DECIMAL."""
    header = F.concat(fixed.u32_bytes(seq), fixed.le_bytes(timestamp_us, 8), fixed.u32_bytes(rate_hz), F.slice(fixed.u32_bytes(mask), 1, 2), fixed.u32_bytes(spc))
    return fixed.fnv1a64(F.concat(header, F.flatten(F.transform(samples, fixed.u32_bytes))))


def describe(df: DataFrame) -> DataFrame:
    """The frames' headers; samples never show."""
    n = enabled_count(F.col("channel_mask"))
    return df.select("seq", "timestamp_us", "rate_hz", "channel_mask", F.floor(F.size("samples") / n).cast("int").alias("samples_per_channel"), F.lit("<redacted>").alias("samples"))


def column(samples: Column, n: int | Column, col: int | Column) -> Column:
    """One channel of interleaved samples."""
    n, col = (F.lit(v) if isinstance(v, int) else v for v in (n, col))
    return F.filter(samples, lambda _, i: i % n == col)


def to_series(df: DataFrame, keys: list[str], samples: str = "samples", n: str | None = None) -> DataFrame:
    """A row for each key and enabled column: col, channel, x. No shuffle: a frame holds its channels."""
    count = F.col(n) if n else enabled_count(F.col("channel_mask"))
    cols = F.explode(F.sequence(F.lit(0), count - 1))
    out = df.select(*keys, samples, "channel_mask", cols.alias("col"))
    return out.select(*keys, "col", channel_at(F.col("channel_mask"), F.col("col")).alias("channel"), column(F.col(samples), enabled_count(F.col("channel_mask")), F.col("col")).alias("x"))


def to_long(df: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """A row for each sample: t, col, x."""
    n = enabled_count(F.col("channel_mask"))
    return df.select(*keys, n.alias("n"), F.posexplode(samples).alias("pos", "x")).select(*keys, F.floor(F.col("pos") / F.col("n")).cast("int").alias("t"), (F.col("pos") % F.col("n")).alias("col"), "x")

