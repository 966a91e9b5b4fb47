"""Series of any length as rows of bounded chunks.

A chunk holds up to ``size`` neighbouring samples of a series (``x``), and before them up to
``halo`` samples of the chunks before it (``before``), so that operators that look back a little
read one row alone. No array grows with a series. Samples of a long series are numbered in buckets
of the first order column, so that it is numbered, chunked and measured in many tasks; where all
series are short, one shuffle brings each to a task that numbers and chunks it. Recursive
filters alone take a series in one task, chunk by chunk, with the state carried on.

A chunked series has the keys, ``chunk`` (from 0), ``start_t``, ``x`` and ``before``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import refuse
from ..functions.fixed import dec, dec_fdiv, isqrt, let, log2_q16, longs, num, sat32, tdiv, total
from . import artifact, dsp, filters, spectral, windows

#: Samples of a chunk, buckets in which a long series' samples are numbered, and samples of the longest short one.
CHUNK, BUCKETS, SHORT = 64, 64, 1 << 16


def _rising(c: Column, kind: str) -> Column | None:
    """A number that never falls where the column rises; none for types without one."""
    if kind == "timestamp_ntz":
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    return None if kind in ("string", "binary") or "<" in kind else c.cast("double")


def _key(keys: list[str]) -> Column:
    """The keys as one value that joins and windows are made on: nulls in it are equal."""
    return F.struct(*keys)


def _bucket(first: Column, bounds: list[float]) -> Column:
    """How many of the rising bounds a value reaches, by halving; 0 for null."""

    def of(low: int, high: int) -> Column:
        mid = (low + high + 1) // 2
        return F.lit(low) if low == high else F.when(first >= bounds[mid - 1], of(mid, high)).otherwise(of(low, mid - 1))

    return of(0, len(bounds))


def numbered(df: DataFrame, keys: list[str], order: list[str], x: str, buckets: int = BUCKETS) -> DataFrame:
    """keys, t, x: each sample's place in its series, in a total order."""
    first = _rising(F.col(order[0]), dict(df.dtypes)[order[0]])
    bounds = []
    if buckets > 1 and first is not None:
        # A row in SHORT at most is a long series, so that these are few.
        long = df.groupBy(_key(keys).alias("__key")).agg(F.count("*").alias("__n")).filter(F.col("__n") > SHORT).select("__key", F.lit(True).alias("__long"))
        rows = df.select(_key(keys).alias("__key"), *order, F.col(x).alias("x"), first.alias("__first"))
        if not long.isEmpty():
            shares = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
            of_long = rows.join(F.broadcast(long), "__key")
            bounds = sorted(set(of_long.select(F.percentile_approx("__first", shares, 1000)).first()[0] or []))
    if not bounds:
        # What follows costs far more than the few bytes shuffled tell, so that small shuffles aren't made into a few tasks.
        dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return dealt.select(*keys, (nth.cast("long") - 1).alias("t"), F.col(x).alias("x"))
    rows = rows.join(F.broadcast(long), "__key", "left")
    rows = rows.withColumn("__bucket", F.when(F.col("__long"), _bucket(F.col("__first"), bounds)).otherwise(0)).drop("__first")
    seen = rows.filter("__long").groupBy("__key", "__bucket").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = seen.select("__key", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy(*order))
    out = rows.withColumn("__nth", nth).join(offsets, ["__key", "__bucket"], "left")
    return out.select("__key.*", (F.coalesce("__before", F.lit(0)) + F.col("__nth") - 1).alias("t"), "x")


def chunked(df: DataFrame, keys: list[str], order: list[str], x: str, halo: int = 0, size: int = CHUNK) -> DataFrame:
    """A series of rows' values in a total order, as chunks."""
    chunk = lambda t: F.floor(t / size).cast("int")
    rows = numbered(df, keys, order, x)
    dealt = rows.select(*keys, "t", "x", F.explode(F.sequence(chunk(F.col("t")), chunk(F.col("t") + halo))).alias("chunk"))
    held = dealt.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("__rows"))
    start = F.col("chunk").cast("long") * size
    own = lambda mine: F.transform(F.filter("__rows", lambda r: (r["t"] >= start) if mine else (r["t"] < start)), lambda r: r["x"])
    return held.select(*keys, "chunk", start.alias("start_t"), own(True).alias("x"), own(False).alias("before")).filter(F.size("x") > 0)


def _both() -> Column:
    return F.concat("before", "x")


def fir(chunks: DataFrame, coeffs: list[int], shift: int) -> DataFrame:
    """Adds ``y``; needs a halo of one less than the coefficients."""
    return chunks.withColumn("y", F.slice(dsp.fir(_both(), coeffs, shift), F.size("before") + 1, F.size("x")))


def decimate(chunks: DataFrame, factor: int, rate_hz: int, band_limit_milli_hz: int) -> DataFrame:
    """Adds ``kept``, every factor-th sample of the series, with the aliasing check."""
    refuse(factor == 0 or rate_hz // factor == 0, "InvalidDecimation")
    refuse(rate_hz // factor * 1000 <= 2 * band_limit_milli_hz, "AliasingRisk")
    return chunks.withColumn("kept", F.filter("x", lambda _, i: (F.col("start_t") + i) % factor == 0))


def epochs(chunks: DataFrame, keys: list[str], window: int, hop: int) -> DataFrame:
    """A row for each window: epoch_index, start_t, len_t, x. A window is made where it ends, so a
    halo of one less than the window is needed. Series too short for one give none (``refused``)."""
    refuse(window <= 0 or hop <= 0, "InvalidWindow")
    start, n = F.col("start_t"), F.size("x")
    least = F.greatest(F.ceil((start - window + 1) / hop), F.lit(0)).cast("int")
    most = F.floor((start + n - window) / hop).cast("int")
    indices = F.when(most >= least, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))

    def cut(both: Column) -> Column:
        first = lambda k: (k.cast("long") * hop - (start - F.size("before"))).cast("int")
        return F.transform(indices, lambda k: F.struct(k.alias("k"), F.slice(both, first(k) + 1, F.lit(window)).alias("x")))

    # The windows leave the generator as values: cut above it, they'd be cut again at each mention of x.
    rows = chunks.select(*keys, F.explode(let(_both(), cut)).alias("__w")).select(*keys, F.col("__w.k").alias("epoch_index"), F.col("__w.x").alias("x"))
    return rows.select(*keys, "epoch_index", (F.col("epoch_index") * hop).alias("start_t"), F.lit(window).alias("len_t"), "x")


def refused(df: DataFrame, keys: list[str], window: int, hop: int) -> DataFrame:
    """keys, n, error: the series that hold no window, from rows of samples."""
    rows = df.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    return rows.withColumn("error", windows.window_error(F.col("n"), F.lit(window), F.lit(hop))).filter("error is not null")


def sums(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n, total, abs_total, squares (DECIMAL), low, high, zero_crossings, jump (the largest
    step) of each series, summed up before the shuffle. Needs a halo of 1."""
    x, last = F.col("x"), F.element_at("before", -1)
    pairs = F.zip_with(F.slice(F.concat(F.when(F.size("before") > 0, F.array(last)).otherwise(F.slice(x, 1, 1)), x), F.lit(1), F.size(x)), x, lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")))
    flips = F.size(F.filter(pairs, lambda p: ((p["a"] < 0) & (p["b"] > 0)) | ((p["a"] > 0) & (p["b"] < 0))))
    each = chunks.select(
        *keys,
        F.size(x).cast("long").alias("n"),
        total(longs(x)).alias("total"),
        total(F.transform(x, lambda v: F.abs(v.cast("long")))).alias("abs_total"),
        total(F.transform(x, lambda v: dec(dec(v.cast("long")) * dec(v.cast("long")))), num(0)).alias("squares"),
        F.array_min(x).cast("long").alias("low"),
        F.array_max(x).cast("long").alias("high"),
        flips.alias("flips"),
        F.array_max(F.transform(pairs, lambda p: F.abs(p["b"] - p["a"]))).alias("jump"),
    )
    whole = lambda c: F.sum(c).alias(c)
    return each.groupBy(*keys).agg(whole("n"), whole("total"), whole("abs_total"), dec(F.sum("squares")).alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("flips").cast("int").alias("zero_crossings"), F.max("jump").alias("jump"))


def _joined(chunks: DataFrame, keys: list[str], other: DataFrame) -> DataFrame:
    """The chunks with what is known of their series; a long series' rows can be dealt to many tasks."""
    known = other.select(_key(keys).alias("__key"), *(c for c in other.columns if c not in keys))
    return chunks.withColumn("__key", _key(keys)).join(known, "__key").drop("__key")


def remove_mean(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the series' truncated ``mean``, and ``y``, the samples less it."""
    means = chunks.groupBy(*keys).agg(F.sum(total(longs(F.col("x")))).alias("__s"), F.sum(F.size("x")).alias("__n"))
    means = means.select(*keys, tdiv(F.col("__s"), F.col("__n")).alias("mean"))
    return _joined(chunks, keys, means).withColumn("y", F.transform("x", lambda v: sat32(v.cast("long") - F.col("mean"))))


def features(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variance, log_variance_q16, rms, abs_mean, zero_crossings of each series, by exact sums."""
    s = sums(chunks, keys).withColumn("mean", tdiv(F.col("total"), F.col("n")))
    m, n = dec(F.col("mean")), dec(F.col("n"))
    around = dec(dec(F.col("squares") - dec(num(2) * dec(m * dec(F.col("total"))))) + dec(n * dec(m * m)))
    s = s.withColumn("v", dec_fdiv(around, n))
    return s.select(*keys, F.col("v").cast("long").alias("variance"), log2_q16(F.col("v")).alias("log_variance_q16"), isqrt(F.col("v")).cast("long").alias("rms"), tdiv(F.col("abs_total"), F.col("n")).alias("abs_mean"), "zero_crossings")


def artifact_scan(chunks: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """keys, flag: clean, amplitude_exceeded or saturated, which dominates."""
    refuse(threshold <= 0, "InvalidThreshold")
    ends = chunks.groupBy(*keys).agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    rail = (F.col("high") >= artifact.ADC24_MAX) | (F.col("low") <= artifact.ADC24_MIN)
    return ends.select(*keys, F.when(rail, "saturated").when((F.col("high") > threshold) | (F.col("low") < -threshold), "amplitude_exceeded").otherwise("clean").alias("flag"))


def artifact_screen(chunks: DataFrame, keys: list[str], limits: artifact.ScreenLimits) -> DataFrame:
    """keys, bits: all findings of each series. Needs a halo of 1."""
    refuse(limits.amplitude <= 0, "InvalidThreshold")
    s = sums(chunks, keys)
    bit = lambda test, value: F.when(test, value).otherwise(0)
    low, high = F.col("low"), F.col("high")
    bits = bit((high >= artifact.ADC24_MAX) | (low <= artifact.ADC24_MIN), artifact.SATURATED) + bit((high > limits.amplitude) | (low < -limits.amplitude), artifact.AMPLITUDE)
    if limits.slew > 0:
        bits = bits + bit(F.col("jump") > limits.slew, artifact.SLEW)
    if limits.flat_range > 0:
        bits = bits + bit(high - low <= limits.flat_range, artifact.FLATLINE)
    if limits.drift > 0:
        quarter = F.floor(F.col("n") / 4).cast("long")
        rows = _joined(chunks.select(*keys, "start_t", "x"), keys, s.select(*keys, "n"))
        within = lambda test: total(F.transform("x", lambda v, i: F.when(test(F.col("start_t") + i), v.cast("long")).otherwise(F.lit(0).cast("long"))))
        ends = rows.select(*keys, within(lambda t: t < quarter).alias("head"), within(lambda t: t >= F.col("n") - quarter).alias("tail"))
        s = _joined(s, keys, ends.groupBy(*keys).agg(F.sum("head").alias("head"), F.sum("tail").alias("tail")))
        part = lambda c: tdiv(F.col(c), F.greatest(quarter, F.lit(1).cast("long")))
        bits = bits + bit((quarter > 0) & (F.abs(part("tail") - part("head")) > limits.drift), artifact.DRIFT)
    return s.select(*keys, bits.cast("int").alias("bits"))


# --- recurrences over whole series ---------------------------------------------------------------


def _steps(f, xs: list[int], state: dict[str, int]) -> list[int]:
    """One series alone, in plain integers; ``state`` is carried on in place."""
    sat = lambda a: min(max((a + filters.BIAS) >> filters.SHIFT, -(2**31)), 2**31 - 1)
    out = []
    for x in xs:
        state.update(f.next(state, x, sat))
        out.append(state[f.output])
    return out


def recurrence(chunks: DataFrame, keys: list[str], fs: list, final: bool = False) -> DataFrame:
    """Steps each filter through each series from a zero state, chunk by chunk in order.

    Adds ``y<k>`` (not with ``final``) and ``state<k>`` after the chunk, an array in the order of
    the filter's state. With ``final`` just the last chunk of each series is given. A series goes
    through one task; what is held of it is its state.
    """
    rows = chunks.drop("before").repartition(*keys).sortWithinPartitions(*keys, "chunk")
    names = [f"{c}{k}" for k in range(len(fs)) for c in ([] if final else ["y"]) + ["state"]]
    kind = {"y": "array<int>", "state": "array<bigint>"}
    made = StructType.fromDDL(", ".join(f"{n} {kind[n.rstrip('0123456789')]}" for n in names))
    schema = StructType([*rows.schema.fields, *made.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, last = object(), None, None  # the state and the last row of a series that goes on

        def emit(batch: pa.RecordBatch, columns: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t.type) for c, t in zip(columns, to_arrow_schema(made)))], schema=arrow)

        for t in batches:
            if not t.num_rows:
                continue
            ids, xs = list(zip(*(t[k].to_pylist() for k in keys))), t["x"].to_pylist()
            places = [0] * len(ids)
            for i in range(1, len(ids)):
                places[i] = places[i - 1] + 1 if ids[i] == ids[i - 1] else 0
            states = {ids[0]: held} if ids[0] == held_key else {}
            if last is not None and ids[0] != held_key:
                yield emit(*last)
            columns = [[None] * len(ids) for _ in names]
            by_place: dict[int, list[int]] = {}
            for i, p in enumerate(places):
                by_place.setdefault(p, []).append(i)
            for p in sorted(by_place):  # the p-th chunks here of all series at once
                wave = by_place[p]
                for i in wave:
                    states.setdefault(ids[i], [dict.fromkeys(f.state, 0) for f in fs])
                for k, f in enumerate(fs):
                    if len(wave) < 8:
                        ys = [_steps(f, xs[i], states[ids[i]][k]) for i in wave]
                    else:
                        lengths = np.array([len(xs[i]) for i in wave], np.int64)
                        grid = np.zeros((len(wave), int(lengths.max())), np.int64)
                        for row, i in enumerate(wave):
                            grid[row, : lengths[row]] = xs[i]
                        state = {s: np.array([states[ids[i]][k][s] for i in wave], np.int64) for s in f.state}
                        out = filters.run(f, grid, lengths, state)
                        ys = [y[:n].tolist() for y, n in zip(out, lengths)]
                        for row, i in enumerate(wave):
                            states[ids[i]][k] = {s: int(v[row]) for s, v in state.items()}
                    for i, y in zip(wave, ys):
                        if not final:
                            columns[2 * k][i] = y
                        columns[k if final else 2 * k + 1][i] = [states[ids[i]][k][s] for s in f.state]
            held_key, held = ids[-1], states[ids[-1]]
            if final:  # the last row here may not be the series' last one
                ends = [i for i in range(len(ids) - 1) if ids[i] != ids[i + 1]]
                yield emit(t.take(pa.array(ends, pa.int64())), [[c[i] for i in ends] for c in columns])
                last = t.slice(len(ids) - 1), [c[-1:] for c in columns]
            else:
                yield emit(t, columns)
        if last is not None:
            yield emit(*last)

    return rows.mapInArrow(run, schema)


def goertzel_bank(chunks: DataFrame, keys: list[str], coeffs: list[int], scale_shift: int = 0) -> DataFrame:
    """keys, powers: the narrowband power of each coefficient's bin over each series, as DECIMALs."""
    refuse(not coeffs, "EmptyKernel")
    fs = [spectral.Resonator(c) for c in coeffs]
    power = lambda k, c: let(F.struct(*(F.get(f"state{k}", F.lit(i)).alias(s) for i, s in enumerate(fs[k].state))), lambda s: spectral.power_of(s, F.lit(c).cast("long"), scale_shift))
    return recurrence(chunks, keys, fs, final=True).select(*keys, F.array(*(power(k, c) for k, c in enumerate(coeffs))).alias("powers"))
