"""From samples to published decisions, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import artifact, classify, dsp, features, windows
from .boundary import publish


def decide(series: DataFrame, keys: list[str], class_means: list[list[int]], window: int, hop: int, limits: artifact.ScreenLimits, abstain_below: int = 0) -> DataFrame:
    """Window, screen, condition, measure, classify, publish.

    ``series`` has the keys and ``x``. Everything after the series is row by row, so there is no
    further shuffle.
    """
    return decide_epochs(windows.epochs(series.select(*keys, "x"), window, hop), keys, class_means, limits, abstain_below)


def decide_epochs(epochs: DataFrame, keys: list[str], class_means: list[list[int]], limits: artifact.ScreenLimits, abstain_below: int = 0) -> DataFrame:
    """The same from windows. Those with a disqualifying artifact give no decision."""
    clean = epochs.withColumn("bits", artifact.artifact_screen(F.col("x"), limits)).filter(~artifact.disqualifying(F.col("bits")))
    conditioned = clean.withColumn("y", dsp.fir(dsp.remove_mean(F.col("x")), [1, 2, 1], 2))
    y = F.col("y")
    measured = conditioned.withColumn("feature", F.array(features.log_variance_q16(y).cast("long"), features.abs_mean(y), features.zero_crossings(y).cast("long")))
    decided = measured.withColumn("decision", classify.classify_mdm(F.col("feature"), class_means, abstain_below))
    return publish(decided, [*keys, "epoch_index"])
