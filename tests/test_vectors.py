"""Pinned values: one row a case, one query a section."""

from pyspark.sql import functions as F

from wavemill.functions import fixed
from wavemill.operators import artifact, calibrate, classify, dsp, features, filters, windows
from wavemill.sources import frames
from wavemill.sources.synthetic import lcg_samples


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def ints(xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<int>")


def test_fnv(spark):
    df = rows(spark, [("", "0xcbf29ce484222325"), ("a", "0xaf63dc4c8601ec8c"), ("foobar", "0x85944171f73967e8")], "s string, want string")
    assert all(r.got == r.want for r in df.select("want", fixed.hex64(fixed.fnv1a64(fixed.text_bytes(F.col("s")))).alias("got")).collect())


def test_frame_digest(spark, vectors):
    f = vectors["frame"]
    x = ints(lcg_samples(128))
    h = frames.checksum(F.lit(f["seq"]), F.lit(f["timestamp_us"]), F.lit(f["sample_rate_hz"]), F.lit(f["channel_mask"]), F.lit(f["samples_per_channel"]), x)
    assert one(spark, fixed.hex64(h)) == f["digest"]


def test_window_count(spark, vectors):
    df = rows(spark, [(c["samples_per_channel"], c["window"], c["hop"], c["expected"]) for c in vectors["window_count"]], "n int, w int, h int, want int")
    assert all(r.got == r.want for r in df.select("want", windows.window_count(F.col("n"), F.col("w"), F.col("h")).alias("got")).collect())


def test_masks(spark, vectors):
    df = rows(spark, [(int(c["mask_bits"], 16), c["channel"], c["expected_column"]) for c in vectors["mask_column_of"]], "m int, c int, want int")
    got = df.select("want", "c", frames.column_of(F.col("m"), F.col("c")).alias("got"), frames.channel_at(F.col("m"), frames.column_of(F.col("m"), F.col("c"))).alias("back")).collect()
    assert all(r.got == r.want and (r.got is None or r.back == r.c) for r in got)
    assert one(spark, F.array(*(frames.first_n(F.lit(n)) for n in (0, 1, 15, 16, 200)))) == [0, 1, 32767, 65535, 65535]


def test_artifact_scan(spark, vectors):
    for c in vectors["artifact_scan"]:
        assert one(spark, artifact.artifact_scan(ints(c["samples"]), c["threshold_counts"])) == c["expected"]
    assert one(spark, artifact.artifact_scan(ints([]), 5)) == "clean"
    assert one(spark, artifact.artifact_screen(ints([]))) is None


def test_remove_mean(spark, vectors):
    df = rows(spark, [(c["input"], c["mean_removed"], c["expected"]) for c in vectors["dc_remove"]], "x array<int>, m long, want array<int>")
    assert all(r.got == r.want and r.gm == r.m for r in df.select("want", "m", dsp.remove_mean(F.col("x")).alias("got"), dsp.mean(F.col("x")).alias("gm")).collect())


def test_fir(spark, vectors):
    for c in vectors["fir"]:
        assert one(spark, dsp.fir(ints(c["input"]), c["coeffs"], c["shift"])) == c["expected"]


def test_filters_both_forms(spark, vectors):
    signal = vectors["filter_signal"]
    df = rows(spark, [(signal,), ([],), (None,), (signal[:5],)], "x array<int>").coalesce(1)
    cases = [(filters.Biquad(tuple(c["coeffs_q15"])), c) for c in vectors["biquad"]] + [(filters.DcBlocker(c["r_q15"]), c) for c in vectors["dc_blocker"]]
    for f, c in cases:
        state = filters.state_after(F.col("x"), f)
        got = filters.process(df, f).select("y", filters.filtered(F.col("x"), f).alias("z"), fixed.hex64(filters.state_hash(state, f)).alias("h")).collect()
        assert got[0].y == got[0].z == c["expected"] and got[0].h == c["state_hash"]
        assert got[1].y == got[1].z == [] and got[2].y is None and got[2].z is None
        assert got[3].y == got[3].z == c["expected"][:5]


def test_features(spark, vectors):
    df = rows(spark, [(c["signal"], *(c[k] for k in ("variance", "log_variance_q16", "rms", "abs_mean", "zero_crossings"))) for c in vectors["feature"]], "x array<int>, v long, l int, r long, a long, z int")
    x = F.col("x")
    for r in df.select("*", features.variance(x).cast("long").alias("v2"), features.log_variance_q16(x).alias("l2"), features.rms(x).alias("r2"), features.abs_mean(x).alias("a2"), features.zero_crossings(x).alias("z2")).collect():
        assert (r.v, r.l, r.r, r.a, r.z) == (r.v2, r.l2, r.r2, r.a2, r.z2)


def test_log2_and_isqrt(spark, vectors):
    for c in vectors["log2_q16"]:
        assert one(spark, fixed.log2_q16(fixed.num(c["input"]))) == c["expected_q16"]
    for c in vectors["isqrt"]:
        assert one(spark, fixed.isqrt(fixed.num(c["input"]))) == c["expected"]


def test_nearest_mean(spark, vectors):
    for c in vectors["classify_mdm"]:
        assert one(spark, classify.decision_text(classify.classify_mdm(ints(c["feature"]), c["class_means"], c["abstain_below_permille"]))) == c["expected"]


def test_linear(spark, vectors):
    for c in vectors["classify_lda"]:
        x = ints(c["feature"])
        assert one(spark, classify.lda_score(x, c["weights"], c["bias"])) == c["score"]
        assert one(spark, classify.decision_text(classify.classify_lda_binary(x, c["weights"], c["bias"], c["abstain_band"]))) == c["expected"]


def test_covariance(spark, vectors):
    for c in vectors["covariance"]:
        assert one(spark, calibrate.covariance(F.array(*(ints(x) for x in c["channels"])), len(c["channels"]))) == c["expected"]


def test_whitening(vectors):
    for c in vectors["whiten_cholesky"]:
        w = calibrate.whiten_cholesky(c["reference"])
        assert w == c["whitener_q16"]
        if w:
            assert calibrate.align(w, c["reference"]) == c["align_q16"]
