"""Readers of frames and the one writer: decisions alone leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.boundary import assert_boundary_safe
from .frames import FRAME, validate_frames


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet", strict: bool = False) -> DataFrame:
    """Frames with a fixed schema (nothing is inferred) and their errors."""
    return validate_frames(spark.read.schema(FRAME).format(fmt).load(path), strict)


def read_fixtures(spark: SparkSession, path: str, session_id: str = "fixture", strict: bool = False) -> DataFrame:
    """Frames of JSON documents with a ``frame`` object each: seq, timestamp_us, sample_rate_hz, channel_mask, samples."""
    inner = "struct<seq:bigint,timestamp_us:bigint,sample_rate_hz:bigint,channel_mask:int,samples:array<int>>"
    f = spark.read.schema(f"frame {inner}").option("multiLine", True).json(path).select("frame.*")
    frames = f.withColumnRenamed("sample_rate_hz", "rate_hz").withColumn("session_id", F.lit(session_id))
    return validate_frames(frames.select(FRAME.names), strict)


def stream_frames(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """The same from a folder that files are added to."""
    return validate_frames(spark.readStream.schema(FRAME).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path))


def write_decisions(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Refuses any column that is no key and no part of a decision."""
    assert_boundary_safe(df, keys)
    df.write.format(fmt).mode(mode).save(path)
