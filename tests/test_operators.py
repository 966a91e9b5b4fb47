"""Literal cases and properties of operators without pinned vectors, and refusals."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.errors import MESSAGES, PipelineError
from wavemill.functions import fixed
from wavemill.operators import artifact, calibrate, classify, dsp, features, filters, rate, spatial, spectral, windows
from wavemill.plans.boundary import assert_boundary_safe, publish
from wavemill.sources import frames


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def ints(xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<int>")


def code(f):
    with pytest.raises(PipelineError) as e:
        f()
    assert str(e.value) == MESSAGES[e.value.code]
    return e.value.code


def test_references(spark):
    assert one(spark, spatial.common_average(ints([110, 90, 100, 210, 190, 200]), 3)) == [10, -10, 0, 10, -10, 0]
    assert one(spark, spatial.single_reference(ints([10, 20, 30]), 3, 1)) == [-10, 0, 10]
    assert one(spark, spatial.average_reference(ints([100, 50, 200]), 3, [0, 2])) == [-50, -100, 50]
    assert one(spark, spatial.common_average(ints([1, 0, 0, 0]), 4)) == [1, 0, 0, 0]
    assert one(spark, spatial.spatial_filter(ints([1, 0, 0, 0]), spatial.common_average_weights(4))) == [0, -1, -1, -1]
    assert one(spark, spatial.common_average(ints([1, 2, 3]), 2)) is None
    assert code(lambda: spatial.single_reference(ints([1]), 1, 1)) == "DimensionMismatch"
    assert code(lambda: spatial.average_reference(ints([1]), 1, [])) == "EmptyChannelMask"


def test_spatial_filter(spark):
    one_, both = spatial.ONE, [[spatial.ONE, spatial.ONE], [spatial.ONE, -spatial.ONE]]
    assert one(spark, spatial.spatial_filter(ints([300, 100, 50, 20]), both)) == [400, 200, 70, 30]
    assert one(spark, spatial.spatial_filter(ints([400, 400, 400, 400]), [[one_ // 4] * 4])) == [400]
    assert one(spark, spatial.spatial_filter(ints([2**31 - 1, 2**31 - 1]), both)) == [2**31 - 1, 0]


def test_baseline(spark):
    assert one(spark, spatial.remove_baseline(ints([10, 1, 20, 2, 30, 3]), 2, 2)) == [-5, 0, 5, 1, 15, 2]
    assert one(spark, spatial.remove_baseline(ints([1, 2]), 2, 2)) is None
    assert code(lambda: spatial.remove_baseline(ints([1]), 1, 0)) == "InvalidWindow"


def test_decimation(spark):
    assert one(spark, rate.decimate_unfiltered(ints([10, 11, 20, 21, 30, 31, 40, 41]), 2, 3)) == [10, 11, 40, 41]
    assert one(spark, F.array(*(rate.decimated_frames(F.lit(n), F.lit(f)) for n, f in ((7, 3), (6, 3), (0, 3), (5, 0))))) == [3, 2, 0, 0]
    assert code(lambda: rate.decimate_checked(ints([1]), 1, 5, 250, 40_000)) == "AliasingRisk"
    assert code(lambda: rate.decimate_checked(ints([1]), 1, 5, 250, 25_000)) == "AliasingRisk"
    assert code(lambda: rate.decimate_checked(ints([1]), 1, 251, 250, 1)) == "InvalidDecimation"
    assert one(spark, rate.decimate_checked(ints([1, 2, 3, 4, 5, 6]), 1, 5, 250, 20_000)) == [1, 6]
    assert rate.sample_rate(0) is None and rate.sample_rate(250) == 250


def test_screen(spark):
    limits = artifact.ScreenLimits(1000, 100, 10, 200)
    bits = lambda xs, lim=limits: one(spark, artifact.artifact_screen(ints(xs), lim))
    assert bits([0, 20, 40, 20]) == 0
    assert bits([0, 150, 200, 180]) == artifact.SLEW
    assert bits([5, 5, 6, 5]) == artifact.FLATLINE
    assert bits([0, 90, 180, 270, 360, 450, 540, 630]) == artifact.DRIFT
    assert bits([8388607, 8388607], artifact.ScreenLimits.amplitude_only(1000)) == artifact.SATURATED | artifact.AMPLITUDE
    assert one(spark, artifact.artifact_screen_block(ints([0, 5, 20, 5, 40, 5]), 2, limits)) == [0, artifact.FLATLINE]
    assert one(spark, artifact.artifact_screen_block(ints([1] * 6), 1, limits, max_frames=5)) is None
    assert one(spark, F.array(*(artifact.disqualifying(F.lit(b)) for b in (0, 1, 2, 4, 8, 16)))) == [False, True, False, True, True, False]
    assert code(lambda: artifact.artifact_scan(ints([1]), 0)) == "InvalidThreshold"


def test_goertzel(spark):
    for hz in range(1, 125):
        assert abs(spectral.goertzel_coeff_q14(hz * 1000, 250) - round(2 * math.cos(2 * math.pi * hz / 250) * 16384)) <= 24, hz
    assert [spectral.goertzel_coeff_q14(f * 1000, 250) for f in (8, 10, 13, 31)] == [32108, 31738, 31036, 23316]
    assert spectral.goertzel_coeff_q14(0, 250) is None and spectral.goertzel_coeff_q14(125_000, 250) is None
    tone = [round(1000 * math.sin(2 * math.pi * 13 * t / 250)) for t in range(250)]
    p = one(spark, spectral.goertzel_bank(ints(tone), [spectral.goertzel_coeff_q14(f * 1000, 250) for f in (8, 10, 13, 15)], 4))
    assert max(p) == p[2]
    n = fixed.num
    ratios = [(1, 2), (2, 1), (5, 0), (0, 5), (2**60, 2**60), (2**64 - 1, 2**64 - 1), (2**50, 1)]
    assert one(spark, F.array(*(spectral.power_ratio_permille(n(a), n(b)) for a, b in ratios))) == [500, 2000, None, 0, 15, 1, 2**32 - 1]
    assert one(spark, spectral.goertzel_power(ints([]), 5)) is None
    assert code(lambda: spectral.goertzel_power(ints([1]), 32769)) == "InvalidCoefficient"
    assert code(lambda: spectral.goertzel_power(ints([1]), 0, 32)) == "InvalidShift"
    assert code(lambda: spectral.goertzel_bank(ints([1]), [])) == "EmptyKernel"


def test_saturation_and_refusals(spark):
    assert one(spark, dsp.fir(ints([2**31 - 1, -(2**31)]), [3], 0)) == [2**31 - 1, -(2**31)]
    assert one(spark, features.variance(ints([2**31 - 1, -(2**31)])).cast("string")) == "4611686016279904256"
    assert code(lambda: dsp.fir(ints([1]), [], 0)) == "EmptyKernel" and code(lambda: dsp.fir(ints([1]), [1], 32)) == "InvalidShift"
    assert code(lambda: filters.notch_coeffs("50", 333)) == "UnsupportedSampleRate"
    assert code(lambda: filters.DcBlocker(0)) == code(lambda: filters.DcBlocker(32768)) == "InvalidCoefficient"
    assert code(lambda: classify.classify_mdm(ints([1]), [])) == "EmptyClassSet"
    assert code(lambda: classify.classify_lda_binary(ints([1]), [1], 0, -1)) == "InvalidThreshold"
    assert code(lambda: calibrate.drift_update(F.lit(None), F.lit(None), 32769)) == "InvalidCoefficient"
    assert code(lambda: windows.epochs(spark.range(1), 0, 1)) == "InvalidWindow"
    assert one(spark, classify.decision_text(classify.classify_lda_binary(ints([0]), [1], 0, 0))) == "Intent(class=1, confidence_permille=0)"


def test_windows_gapped(spark):
    df = spark.createDataFrame([(1, list(range(16))), (2, [1])], "k int, x array<int>")
    got = windows.epochs(df, 3, 5).orderBy("epoch_index").collect()
    assert [(r.k, r.start_t, r.x) for r in got] == [(1, 0, [0, 1, 2]), (1, 5, [5, 6, 7]), (1, 10, [10, 11, 12])]


def test_frames(spark):
    df = spark.createDataFrame([(0, [1, 2]), (3, [1, 2, 3]), (3, []), (5, [1, 2, 3, 4]), (3, None)], "channel_mask int, samples array<int>")
    got = frames.validate_frames(df).collect()
    assert [r.error for r in got] == ["EmptyChannelMask", "SampleLengthMismatch", "SampleLengthMismatch", None, "SampleLengthMismatch"]
    assert got[3].samples_per_channel == 2
    good = df.filter("channel_mask = 5").withColumn("k", F.lit(1))
    assert [(r.col, r.channel, r.x) for r in frames.to_series(good, ["k"]).orderBy("col").collect()] == [(0, 0, [1, 3]), (1, 2, [2, 4])]
    assert [(r.t, r.col, r.x) for r in frames.to_long(good, ["k"]).orderBy("t", "col").collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]
    with pytest.raises(Exception, match="EmptyChannelMask"):
        frames.validate_frames(df.filter("channel_mask = 0"), strict=True).collect()  # of several, any may come first


def test_covariance_errors(spark):
    cov = lambda chans, n: one(spark, calibrate.covariance_error(F.array(*(ints(c) for c in chans)), n))
    assert cov([[1]], 2) == "DimensionMismatch" and cov([[], [1]], 2) == "EmptyInput" and cov([[1], []], 2) == "SampleLengthMismatch"


def test_inverse_root():
    near = lambda m, want, by: all(abs(a - b) <= by for r, w in zip(m, want) for a, b in zip(r, w))
    assert near(calibrate.inverse_sqrt_spd([[1000, 0], [0, 1000]], 0), [[2072, 0], [0, 2072]], 2)
    assert calibrate.inverse_sqrt_spd([[2500, 900], [900, 1600]]) == [[1416, -376], [-376, 1792]]
    assert calibrate.inverse_sqrt_spd([[0, 0], [0, 0]]) is None and calibrate.inverse_sqrt_spd([[-5]]) is None
    d = calibrate.inverse_sqrt_spd([[400, 0, 0], [0, 900, 0], [0, 0, 2500]], 0)
    assert near(d, [[65536 // 20, 0, 0], [0, 65536 // 30, 0], [0, 0, 65536 // 50]], 3)


def test_online_aligner_trace():
    a = calibrate.OnlineAligner(3, 2000)
    assert not a.refresh_due and not a.refresh() and a.whitener is None
    m = [[1000, 10], [10, 900]]
    seen = []
    for _ in range(7):
        seen.append(a.step(m)[:4])
    assert seen == [(1, 1, True, 1), (2, 1, False, 1), (3, 2, False, 1), (4, 3, True, 2), (5, 1, False, 2), (6, 2, False, 2), (7, 3, True, 3)]
    never = calibrate.OnlineAligner(0)
    never.observe(m)
    assert never.refresh_due and never.refresh() and not never.refresh_due
    z = calibrate.ZeroCalib()
    assert z.mean() is None and z.whitener() is None
    z.observe([[-7, 0], [0, 4]])
    z.observe([[0, 0], [0, 4]])
    assert z.mean() == [[-3, 0], [0, 4]] and z.whitener() is None


def test_drift_and_session_mean(spark):
    df = spark.createDataFrame([(1, [[100, -7]]), (1, [[200, 0]])], "k int, cov array<array<bigint>>")
    r = calibrate.drift_update(F.array(F.array(F.lit(100).cast("long"))), F.array(F.array(F.lit(200).cast("long"))), 1 << 14)
    assert one(spark, r) == [[150]]
    square = spark.createDataFrame([(1, [[100, -7], [-7, 5]]), (1, [[200, 0], [0, 6]]), (2, None)], "k int, cov array<array<bigint>>")
    assert [tuple(r) for r in calibrate.session_mean(square, ["k"]).collect()] == [(1, [[150, -3], [-3, 5]], 2)]
    assert df.count() == 2


def test_boundary(spark):
    df = spark.range(2).withColumn("x", F.array(F.lit(1))).withColumn("decision", classify.no_intent())
    assert publish(df, ["id"]).columns == ["id", "kind", "class", "confidence_permille"]
    with pytest.raises(ValueError, match="x may not leave"):
        assert_boundary_safe(df, ["id"])
    with pytest.raises(ValueError, match="no scalar"):
        publish(df, ["x"])
    described = frames.describe(spark.createDataFrame([(1, 2, 250, 3, [5, 6])], "seq long, timestamp_us long, rate_hz long, channel_mask int, samples array<int>"))
    assert described.first()["samples"] == "<redacted>"


counts = st.integers(-(2**31), 2**31 - 1)


@settings(max_examples=15, deadline=None)
@given(st.lists(counts, min_size=2, max_size=12))
def test_rereference_saturates_and_features_agree(spark, xs):
    xs = xs[: len(xs) // 2 * 2]
    got = spark.range(1).select(
        spatial.common_average(ints(xs), 2).alias("car"), spatial.spatial_filter(ints(xs), spatial.identity_weights(2, 2)).alias("same"), features.variance(ints(xs)).alias("v"), features.rms(ints(xs)).alias("r"), features.log_variance_q16(ints(xs)).alias("l")
    ).first()
    clip = lambda v: max(-(2**31), min(2**31 - 1, v))
    trunc = lambda a, b: abs(a) // b * (1 if a >= 0 else -1)
    assert got.car == [clip(x - trunc(xs[i // 2 * 2] + xs[i // 2 * 2 + 1], 2)) for i, x in enumerate(xs)]
    assert got.same == xs
    mean = trunc(sum(xs), len(xs))
    v = sum((x - mean) ** 2 for x in xs) // len(xs)
    assert int(got.v) == v and got.r == math.isqrt(v)
    if v:
        assert abs(got.l / 65536 - math.log2(v)) < 1e-3


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_roots_of_any_u64(spark, x):
    got = spark.range(1).select(fixed.isqrt(fixed.num(x)).alias("r"), fixed.log2_q16(fixed.num(x)).alias("l")).first()
    assert int(got.r) == math.isqrt(x)
    if x:
        assert abs(got.l / 65536 - math.log2(x)) < 1e-3


def random_spd(c, seed, scale):
    """A covariance of c mixed channels, rounded; symmetric and far from singular."""
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) for _ in range(c)] for _ in range(c)]
    return [[round(scale * (sum(a * b for a, b in zip(mix[i], mix[j])) + 2 * (i == j))) for j in range(c)] for i in range(c)]


@pytest.mark.parametrize("c", [2, 3, 5, 8])
@pytest.mark.parametrize("seed", range(3))
def test_whiteners_of_any_size_whiten(spark, c, seed):
    """W R W' is the identity in Q16, up to the rounding of both kernels; a kernel frame gives the same."""
    r = random_spd(c, seed, 40_000)
    eye = [[65536 * (i == j) for j in range(c)] for i in range(c)]
    for w, most in ((calibrate.whiten_cholesky(r), 2500), (calibrate.inverse_sqrt_spd(r, 0), 2500)):
        got = calibrate.align(w, r)
        assert max(abs(a - b) for x, y in zip(got, eye) for a, b in zip(x, y)) <= most
    if not seed:
        df = spark.createDataFrame([(r,), (None,)], "r array<array<bigint>>")
        df = calibrate.with_matrix(calibrate.with_matrix(df, calibrate.whiten_cholesky, ["r"], "w"), calibrate.align, ["w", "r"], "a")
        assert [(x.w, x.a) for x in df.collect()] == [(calibrate.whiten_cholesky(r), calibrate.align(calibrate.whiten_cholesky(r), r)), (None, None)]


def test_matrices_out_of_range(spark):
    assert calibrate.whiten_cholesky([[1 << 31]]) is None and calibrate.whiten_cholesky([[(1 << 31) - 1]]) is not None
    df = spark.createDataFrame([([[2**62]], [[2**62]])], "w array<array<bigint>>, r array<array<bigint>>")
    assert calibrate.with_matrix(df, calibrate.align, ["w", "r"], "a").first().a is None


def test_reports_and_codes(spark):
    bits = F.lit(0b11100101)
    row = spark.range(1).select(artifact.from_bits(bits).alias("a"), artifact.with_flag(artifact.clean(), artifact.DRIFT).alias("b"), artifact.is_clean(artifact.clean()).alias("c"), artifact.has(bits, artifact.SLEW).alias("d")).first()
    assert tuple(row) == (0b00101, 16, True, True)
    empty, odd = ints([]), ints([1, 2, 3])
    assert one(spark, dsp.input_error(empty)) == "EmptyInput" and one(spark, dsp.input_error(odd)) is None
    for error in (rate.decimate_error, lambda s, n: spatial.baseline_error(s, n, 1), artifact.block_screen_error):
        assert [one(spark, error(s, n)) for s, n in ((odd, 0), (empty, 2), (odd, 2), (odd, 3))] == ["EmptyChannelMask", "SampleLengthMismatch", "SampleLengthMismatch", None]
    assert one(spark, spatial.baseline_error(odd, 1, 4)) == one(spark, artifact.block_screen_error(odd, 1, 2)) == "WindowTooLarge"
    assert one(spark, F.array(rate.valid_rate(F.lit(0)), rate.valid_rate(F.lit(250)))) == [None, 250]


def test_drift_of_a_stream_is_the_replay(spark):
    """The ordered stream of a session gives what the fold over its array gives; null matrices are skipped."""
    rng = random.Random(6)
    rows = [(k % 3 or None, k, None if k == 7 else [[rng.randrange(-(10**9), 10**9) for _ in range(2)] for _ in range(2)]) for k in range(40)]
    df = spark.createDataFrame(rows, "s int, t int, cov array<array<bigint>>").repartition(4)
    got = {r.s: r.reference for r in calibrate.drift_stream(df, "s", "t", 3277).collect()}
    for s in {r[0] for r in rows}:
        mine = [c for k, t, c in rows if k == s and c]
        one_row = spark.createDataFrame([(mine[1:], mine[0])], "a array<array<array<bigint>>>, b array<array<bigint>>")
        assert got[s] == one_row.select(calibrate.drift_replay(F.col("a"), F.col("b"), 3277).alias("r")).first().r
