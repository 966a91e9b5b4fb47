"""Count-based windows: tumbling, sliding or gapped; a trailing part of one is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import refuse


def window_count(n: Column, window: Column, hop: Column) -> Column:
    """How many windows n instants hold; null where none may be asked for."""
    ok = (window > 0) & (hop > 0) & (window <= n)
    return F.when(ok, F.floor((n - window) / F.when(hop > 0, hop)).cast("int") + 1)


def window_error(n: Column, window: Column, hop: Column) -> Column:
    return F.when((window <= 0) | (hop <= 0), "InvalidWindow").when(window > n, "WindowTooLarge")


def epochs(df: DataFrame, window: int, hop: int, x: str = "x", channels: int = 1) -> DataFrame:
    """A row for each window of each array: epoch_index, start_t, len_t and the window's samples.

    The array may be interleaved (``channels``). Rows too short for one window give none.
    """
    refuse(window <= 0 or hop <= 0, "InvalidWindow")
    n = F.floor(F.size(x) / channels).cast("int")
    count = window_count(n, F.lit(window), F.lit(hop))
    index = F.explode(F.when(count.isNotNull(), F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")))
    names = [c for c in df.columns if c != x]
    out = df.select(*names, x, index.alias("epoch_index"))
    start = F.col("epoch_index") * hop
    # slice() would copy the whole array for each window.
    samples = F.transform(F.sequence(start * channels, (start + window) * channels - 1), lambda i: F.get(x, i))
    return out.select(*names, "epoch_index", start.alias("start_t"), F.lit(window).alias("len_t"), samples.alias(x))
