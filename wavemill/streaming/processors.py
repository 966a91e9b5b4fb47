"""Keyed state over streams: recursive filters and the online aligner.

Within a micro-batch a key's rows are taken in the order of ``seq``. Rows whose seq is not above
the last one seen are late or repeated; they are dropped and counted. Gaps do not reset state.
Refreshes are driven by counts, so no timers are used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.calibrate import MATRIX, OnlineAligner, ZeroCalib
from ..operators.filters import Biquad, DcBlocker, run


def _ordered(rows: Iterator[pd.DataFrame], last: int) -> tuple[pd.DataFrame, int]:
    """The new rows in order, and how many were late or repeated."""
    pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
    new = pdf[pdf["seq"] > last].drop_duplicates("seq")
    return new, len(pdf) - len(new)


class FilterProcessor(StatefulProcessor):
    """Carries a filter's state over the frames of each session and channel."""

    def __init__(self, f: Biquad | DcBlocker):
        self.filter = f

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", f"seq bigint, dropped bigint, {', '.join(f'{k} bigint' for k in self.filter.state)}")

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else (-1, 0, *[0] * len(self.filter.state))
        new, late = _ordered(rows, held[0])
        state = {k: np.array([v], np.int64) for k, v in zip(self.filter.state, held[2:])}
        out, last, dropped = [], held[0], held[1] + late
        for seq, x, reset in zip(new["seq"], new["x"], new["reset"]):
            if reset:  # coefficients stay, the state is as at the start
                state = {k: np.zeros(1, np.int64) for k in self.filter.state}
            xs = np.asarray(x, np.int64)[None, :]
            y = run(self.filter, xs, np.array([xs.shape[1]]), state)[0]
            out.append((*key, int(seq), y.astype(np.int32).tolist(), dropped))
            last = int(seq)
        self.state.update((last, dropped, *(int(state[k][0]) for k in self.filter.state)))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "col", "seq", "y", "dropped"])

    def close(self) -> None:
        pass


def filter_stream(df: DataFrame, f: Biquad | DcBlocker) -> DataFrame:
    """session_id, col, seq, y, dropped from session_id, col, seq, x.

    A true value in a column ``reset``, if there is one, resets the filter before that row.
    """
    reset = F.coalesce("reset", F.lit(False)) if "reset" in df.columns else F.lit(False)
    schema = "session_id string, col int, seq bigint, y array<int>, dropped bigint"
    return df.select("session_id", "col", "seq", "x", reset.alias("reset")).groupBy("session_id", "col").transformWithStateInPandas(FilterProcessor(f), schema, "Update", "None")


class AlignerProcessor(StatefulProcessor):
    """An ``OnlineAligner`` for each session; sums can pass 64 bits, so the state is text."""

    def __init__(self, refresh_every: int, shrinkage_ppm: int):
        self.refresh_every, self.shrinkage_ppm = refresh_every, shrinkage_ppm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("aligner", "seq bigint, held string")

    def handleInputRows(self, key, rows, timerValues):
        last, held = self.state.get() if self.state.exists() else (-1, "[null, 0, null, 0, 0]")
        total, count, whitener, computed_at, refreshes = json.loads(held)
        aligner = OnlineAligner(self.refresh_every, self.shrinkage_ppm, ZeroCalib(total, count), whitener, computed_at, refreshes)
        new, _ = _ordered(rows, last)
        out = []
        for seq, cov in zip(new["seq"], new["cov"]):
            out.append((*key, int(seq), *aligner.step([[int(v) for v in r] for r in cov])))
            last = int(seq)
        self.state.update((last, json.dumps([aligner.calib.total, aligner.count, aligner.whitener, aligner.computed_at, aligner.refreshes])))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "seq", "observations", "staleness", "refresh_due", "refreshes", "whitener"])

    def close(self) -> None:
        pass


def align_stream(df: DataFrame, refresh_every: int, shrinkage_ppm: int) -> DataFrame:
    """session_id, seq and the aligner's standing after each matrix, from session_id, seq, cov."""
    schema = f"session_id string, seq bigint, observations bigint, staleness bigint, refresh_due boolean, refreshes bigint, whitener {MATRIX}"
    return df.select("session_id", "seq", "cov").groupBy("session_id").transformWithStateInPandas(AlignerProcessor(refresh_every, shrinkage_ppm), schema, "Update", "None")
