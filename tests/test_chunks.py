"""Chunked series against the same operators on whole arrays, for chunks much smaller than a series."""

import random

import pytest
from pyspark.sql import functions as F

from wavemill.errors import PipelineError
from wavemill.functions import fixed
from wavemill.operators import artifact, chunks, dsp, features, filters, spectral, windows
from wavemill.plans.decision import decide_epochs

KEYS = ["k", "c"]


@pytest.fixture(scope="module", params=[5, 64])
def size(request):
    return request.param


@pytest.fixture(scope="module")
def series():
    rng = random.Random(4)
    out = {}
    for n in (1, 2, 4, 5, 6, 17, 63, 64, 65, 200):
        for c in (0, None):
            walk, x = [], rng.randrange(-1000, 1000)
            for _ in range(n):
                x += rng.randrange(-9000, 9000)
                walk.append(x)
            out[n, c] = walk
    out[300, 0] = [2**31 - 1, -(2**31)] * 150
    out[301, 0] = [8_388_607] + [0] * 300
    return out


@pytest.fixture(scope="module")
def rows(spark, series):
    rng = random.Random(5)
    all_ = [(k, c, t // 3, t, v) for (k, c), x in series.items() for t, v in enumerate(x)]
    rng.shuffle(all_)
    return spark.createDataFrame(all_, "k int, c int, ts int, id int, v int").repartition(3).cache()


def whole(spark, series):
    return spark.createDataFrame([(k, c, x) for (k, c), x in series.items()], "k int, c int, x array<int>")


def by_series(df, column):
    """The chunks' arrays joined again."""
    out = {}
    for r in sorted(df.select(*KEYS, "chunk", column).collect(), key=lambda r: r.chunk):
        out.setdefault((r.k, r.c), []).extend(r[column])
    return out


def test_chunks_hold_the_series(rows, series, size):
    df = chunks.chunked(rows, KEYS, ["ts", "id"], "v", 7, size).cache()
    assert by_series(df, "x") == series
    for r in df.collect():
        x = series[r.k, r.c]
        assert 0 < len(r.x) <= size and r.start_t == r.chunk * size and r.before == x[max(0, r.start_t - 7) : r.start_t]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("short, buckets", [(50, 64), (50, 3), (250, 64), (0, 2)])
def test_long_series_are_numbered_in_buckets(monkeypatch, rows, series, short, buckets):
    monkeypatch.setattr(chunks, "SHORT", short)
    df = chunks.numbered(rows, KEYS, ["ts", "id"], "v", buckets)
    assert "__bucket" in plan(df)
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        got.setdefault((r.k, r.c), []).append((r.t, r.x))
    assert got == {k: list(enumerate(x)) for k, x in series.items()}
    df = chunks.chunked(rows, KEYS, ["ts", "id"], "v", 7, 5)
    assert by_series(df, "x") == series


def test_short_series_are_shuffled_once(rows):
    df = chunks.epochs(chunks.chunked(rows, KEYS, ["ts", "id"], "v", 15), KEYS, 16, 8)
    assert plan(df).count("Exchange hashpartitioning") == 1


def test_a_window_is_cut_once_for_all_that_reads_it(spark, rows):
    epochs = chunks.epochs(chunks.chunked(rows, KEYS, ["ts", "id"], "v", 15), KEYS, 16, 8)
    df = decide_epochs(epochs, KEYS, [[1, 2, 3], [4, 5, 6]], artifact.ScreenLimits())
    assert plan(df).count("concat(before") == 1
    for f in (lambda x: dsp.fir(x, [1, 2, 1], 2), artifact.artifact_screen):
        assert plan(spark.range(3).select(f(F.transform(F.array("id"), lambda v: v + 7)).alias("f"))).count("+ 7)") == 1


def test_conditioning(spark, rows, series, size):
    df = chunks.chunked(rows, KEYS, ["ts", "id"], "v", 7, size).cache()
    flat = whole(spark, series)
    taps = [3, -5, 2, 7, 1, 1, 1, -4]
    want = {(r.k, r.c): r for r in flat.select(*KEYS, dsp.fir(F.col("x"), taps, 2).alias("f"), dsp.remove_mean(F.col("x")).alias("m")).collect()}
    assert by_series(chunks.fir(df, taps, 2), "y") == {k: r.f for k, r in want.items()}
    assert by_series(chunks.remove_mean(df, KEYS), "y") == {k: r.m for k, r in want.items()}
    assert by_series(chunks.decimate(df, 3, 250, 40_000), "kept") == {k: x[::3] for k, x in series.items()}


@pytest.mark.parametrize("window, hop", [(16, 6), (4, 4), (3, 11), (1, 1), (64, 1)])
def test_windows(spark, rows, series, size, window, hop):
    df = chunks.chunked(rows, KEYS, ["ts", "id"], "v", window - 1, size)
    key = lambda r: (r.k, r.c is None, r.epoch_index)
    got = sorted(chunks.epochs(df, KEYS, window, hop).collect(), key=key)
    want = sorted(windows.epochs(whole(spark, series), window, hop).select(*KEYS, "epoch_index", "start_t", "len_t", "x").collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert {(r.k, r.c, r.n, r.error) for r in chunks.refused(rows, KEYS, window, hop).collect()} == {(*k, len(x), "WindowTooLarge") for k, x in series.items() if len(x) < window}


def test_measures(spark, rows, series, size):
    df = chunks.chunked(rows, KEYS, ["ts", "id"], "v", 1, size).cache()
    x, limits = F.col("x"), artifact.ScreenLimits(20_000, 8_000, 10_000, 3_000)
    flat = whole(spark, series).select(
        *KEYS, features.variance(x).cast("string").alias("variance"), features.log_variance_q16(x).alias("log_variance_q16"), features.rms(x).alias("rms"), features.abs_mean(x).alias("abs_mean"), features.zero_crossings(x).alias("zero_crossings"),
        artifact.artifact_screen(x, limits).alias("bits"), artifact.artifact_scan(x, 15_000).alias("flag"),
    )
    want = {(r.k, r.c): tuple(r)[2:] for r in flat.collect()}
    got = {(r.k, r.c): (str(r.variance), *tuple(r)[3:]) for r in chunks.features(df, KEYS).collect()}
    bits = {(r.k, r.c): r.bits for r in chunks.artifact_screen(df, KEYS, limits).collect()}
    flags = {(r.k, r.c): r.flag for r in chunks.artifact_scan(df, KEYS, 15_000).collect()}
    assert {k: (*v, bits[k], flags[k]) for k, v in got.items()} == want and len(set(bits.values())) > 5


def test_recurrences(spark, rows, series, size):
    fs = [filters.Biquad(filters.notch_coeffs("50", 250)), filters.DcBlocker(), filters.Biquad(filters.bandpass_coeffs("attention", 500))]
    df = chunks.chunked(rows, KEYS, ["ts", "id"], "v", 0, size).cache()
    out = chunks.recurrence(df, KEYS, fs).cache()
    final = {(r.k, r.c): r for r in chunks.recurrence(df, KEYS, fs, final=True).collect()}
    assert set(final) == set(series)
    for k, f in enumerate(fs):
        want = {(r.k, r.c): r for r in whole(spark, series).select(*KEYS, filters.filtered(F.col("x"), f).alias("y"), filters.state_after(F.col("x"), f).alias("s")).collect()}
        assert by_series(out, f"y{k}") == {key: r.y for key, r in want.items()}
        assert {key: tuple(r[f"state{k}"]) for key, r in final.items()} == {key: tuple(r.s) for key, r in want.items()}
    coeffs = [31738, -20000]
    want = {(r.k, r.c): r.p for r in whole(spark, series).select(*KEYS, spectral.goertzel_bank(F.col("x"), coeffs, 4).alias("p")).collect()}
    assert {(r.k, r.c): r.powers for r in chunks.goertzel_bank(df, KEYS, coeffs, 4).collect()} == want


def test_a_series_goes_on_over_batches(spark, size):
    """Batches of few rows, so that a series begins in one and ends in a later one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        x = {k: [((7 * t + k) % 31) * 500 - 7000 for t in range(40 + k)] for k in range(5)}
        rows = spark.createDataFrame([(k, 0, t, t, v) for k, y in x.items() for t, v in enumerate(y)], "k int, c int, ts int, id int, v int")
        df = chunks.chunked(rows, KEYS, ["ts", "id"], "v", 0, size)
        f = filters.DcBlocker()
        want = {(k, 0): spark.createDataFrame([(y,)], "x array<int>").select(filters.filtered(F.col("x"), f).alias("y")).first().y for k, y in x.items()}
        assert by_series(chunks.recurrence(df, KEYS, [f]), "y0") == want
        assert chunks.recurrence(df, KEYS, [f], final=True).count() == 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_refusals(spark, rows):
    df = chunks.chunked(rows.limit(0), KEYS, ["ts", "id"], "v", 1)
    for out in (df, chunks.features(df, KEYS), chunks.remove_mean(df, KEYS), chunks.recurrence(df, KEYS, [filters.DcBlocker()]), chunks.epochs(df, KEYS, 2, 1)):
        assert out.collect() == []
    for f, code in ((lambda: chunks.epochs(df, KEYS, 0, 1), "InvalidWindow"), (lambda: chunks.decimate(df, 0, 250, 1), "InvalidDecimation"), (lambda: chunks.decimate(df, 2, 250, 63_000), "AliasingRisk"), (lambda: chunks.goertzel_bank(df, KEYS, []), "EmptyKernel"), (lambda: spectral.Resonator(40_000), "InvalidCoefficient")):
        with pytest.raises(PipelineError) as e:
            f()
        assert e.value.code == code


def test_digests_and_logarithms_of_all_64_bits(spark):
    rng = random.Random(9)
    values = [0, 1, 2, 3, 2**32 - 1, 2**32, 2**32 + 1, 2**63 - 1, 2**63, 2**64 - 1] + [rng.getrandbits(rng.randrange(1, 65)) for _ in range(200)]

    def log2(v):
        if not v:
            return 0
        msb = v.bit_length() - 1
        m, out = (v << (32 - msb) if msb <= 32 else v >> (msb - 32)), msb << 16
        for bit in range(15, -1, -1):
            m = (m * m) >> 32
            if m >= 1 << 33:
                m, out = m >> 1, out + (1 << bit)
        return out

    def fnv(data, h):
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").cast("decimal(38,0)").alias("v"))
    eight = fixed.le_bytes(F.col("v"), 8)
    for r in df.select("v", fixed.log2_q16(F.col("v")).alias("l"), eight.alias("b"), fixed.fnv1a64(eight, F.col("v")).alias("h"), fixed.hex64(fixed.fnv1a64(eight)).alias("x")).collect():
        v = int(r.v)
        data = v.to_bytes(8, "little")
        assert r.l == log2(v) and bytes(r.b) == data and int(r.h) == fnv(data, v) and r.x == f"0x{fnv(data, 0xCBF29CE484222325):016x}"
