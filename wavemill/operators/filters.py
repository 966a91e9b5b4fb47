"""Stateful recursive filters of one channel.

Coefficients are Q15. In batch a series is folded from its first sample; the output is saturated
before it is fed back, so the recurrence has no parallel form within a series, and parallelism is
over series. Two forms give equal values: expressions (an ``aggregate`` over the array, for short
series) and ``process``, an Arrow kernel that steps through many series at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PipelineError, refuse
from ..functions.fixed import fnv1a64, half_up, sat32, u32_bytes

SHIFT, ONE, BIAS = 15, 1 << 15, 1 << 14
R_Q15_DEFAULT = 32604
IDENTITY = (32768, 0, 0, 0, 0)
# Tabulated designs (b0, b1, b2, a1, a2) by name and sample rate.
NOTCH = {
    ("50", 250): (32257, -19936, 32257, -19936, 31745),
    ("50", 500): (32450, -52505, 32450, -52505, 32132),
    ("50", 1000): (32600, -62009, 32600, -62009, 32432),
    ("60", 250): (32232, -4048, 32232, -4048, 31696),
    ("60", 500): (32398, -47235, 32398, -47235, 32029),
    ("60", 1000): (32568, -60562, 32568, -60562, 32368),
}
BANDPASS = {
    ("motor_intent", 250): (6957, 0, -6957, -47759, 18854),
    ("motor_intent", 500): (3957, 0, -3957, -56533, 24853),
    ("motor_intent", 1000): (2115, 0, -2115, -61015, 28538),
    ("attention", 250): (2980, 0, -2980, -58676, 26809),
    ("attention", 500): (1566, 0, -1566, -62167, 29635),
    ("attention", 1000): (803, 0, -803, -63869, 31162),
    ("safety_wide", 250): (10747, 0, -10747, -43487, 11274),
    ("safety_wide", 500): (6444, 0, -6444, -52482, 19880),
    ("safety_wide", 1000): (3576, 0, -3576, -58338, 25616),
}


def notch_coeffs(mode: str, rate_hz: int) -> tuple[int, ...]:
    """``mode`` is 50, 60 or disabled, which is the identity at any rate."""
    return IDENTITY if mode == "disabled" else _design(NOTCH, mode, rate_hz)


def bandpass_coeffs(preset: str, rate_hz: int) -> tuple[int, ...]:
    return _design(BANDPASS, preset, rate_hz)


def _design(table: dict, name: str, rate_hz: int) -> tuple[int, ...]:
    if (name, rate_hz) not in table:
        raise PipelineError("UnsupportedSampleRate")
    return table[name, rate_hz]


@dataclass(frozen=True)
class Biquad:
    coeffs: tuple[int, ...] = IDENTITY
    state, output = ("x1", "x2", "y1", "y2"), "y1"

    def next(self, s, x, sat):
        """The new state; its last output is y1. ``s`` maps state names to values."""
        b0, b1, b2, a1, a2 = self.coeffs
        acc = b0 * x + b1 * s["x1"] + b2 * s["x2"] - a1 * s["y1"] - a2 * s["y2"]
        return {"x1": x, "x2": s["x1"], "y1": sat(acc), "y2": s["y1"]}


@dataclass(frozen=True)
class DcBlocker:
    r_q15: int = R_Q15_DEFAULT
    state, output = ("x1", "y1"), "y1"

    def __post_init__(self):
        refuse(not 0 < self.r_q15 < ONE, "InvalidCoefficient")

    @property
    def coeffs(self) -> tuple[int, ...]:
        return (self.r_q15,)

    def next(self, s, x, sat):
        return {"x1": x, "y1": sat((x - s["x1"]) * ONE + self.r_q15 * s["y1"])}


def _fold(x: Column, f: Biquad | DcBlocker, keep: bool) -> Column:
    def step(acc: Column, v: Column) -> Column:
        new = f.next({k: acc[k] for k in f.state}, v.cast("long"), lambda a: sat32(half_up(a, SHIFT)).cast("long"))
        y = new.pop("y1")
        made = lambda w: F.struct(*([F.concat(acc["out"], F.array(w.cast("int"))).alias("out")] if keep else []), *((w if k == "y1" else new[k]).alias(k) for k in f.state))
        return F.get(F.transform(F.array(y), made), F.lit(0))

    zero = F.struct(*([F.array().cast("array<int>").alias("out")] if keep else []), *(F.lit(0).cast("long").alias(k) for k in f.state))
    return F.aggregate(x, zero, step)


def filtered(x: Column, f: Biquad | DcBlocker) -> Column:
    """The filtered series, as an expression."""
    return _fold(x, f, True)["out"]


def state_after(x: Column, f: Biquad | DcBlocker) -> Column:
    """The filter's state after the series."""
    return _fold(x, f, False)


def state_hash(state: Column, f: Biquad | DcBlocker) -> Column:
    """Digest of coefficients and state, as a DECIMAL."""
    values = [F.lit(c).cast("long") for c in f.coeffs] + [state[k] for k in f.state]
    return fnv1a64(F.flatten(F.array(*(u32_bytes(v) for v in values))))


def run(f: Biquad | DcBlocker, xs: np.ndarray, lengths: np.ndarray, state: dict[str, np.ndarray]) -> np.ndarray:
    """Step many series (rows of ``xs``, padded) at once; ``state`` is carried on in place."""
    sat = lambda a: np.clip((a + BIAS) >> SHIFT, -(2**31), 2**31 - 1)
    out = np.zeros(xs.shape, np.int64)
    for t in range(xs.shape[1]):
        live = t < lengths
        for k, v in (new := f.next(state, xs[:, t], sat)).items():
            state[k] = np.where(live, v, state[k])
        out[:, t] = new[f.output]
    return out


def zero_state(f: Biquad | DcBlocker, n: int) -> dict[str, np.ndarray]:
    return {k: np.zeros(n, np.int64) for k in f.state}


def process(df: DataFrame, f: Biquad | DcBlocker, x: str = "x", out: str = "y", chunk: int = 512) -> DataFrame:
    """Adds the filtered series; each row starts from a zero state. A null series stays null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                rows = batch[x].to_pylist()
                lengths = np.array([len(r or ()) for r in rows], np.int64)
                xs = np.zeros((len(rows), int(lengths.max(initial=0))), np.int64)
                for i, r in enumerate(rows):
                    xs[i, : len(r or ())] = r or ()
                ys = run(f, xs, lengths, zero_state(f, len(rows)))
                done = pa.array([None if r is None else y[:n] for r, y, n in zip(rows, ys, lengths)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, done], names=[*batch.schema.names, out])

    return df.mapInArrow(kernel, schema)
