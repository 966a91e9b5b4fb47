"""Frames come in with errors told apart; only decisions go out."""

import pytest
from pyspark.sql import functions as F

from wavemill.operators import artifact
from wavemill.plans.decision import decide
from wavemill.sources import frames, io


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_frames_to_decisions(spark, tmp_path, fmt):
    rows = [("s", k, 1000 * k, 250, 3, [((7 * t + 13 * k) % 90) * 10 - 400 for t in range(64)]) for k in range(4)] + [("s", 9, 0, 250, 0, [1])]
    spark.createDataFrame(rows, frames.FRAME).write.format(fmt).save(str(tmp_path / "in"))
    read = io.read_frames(spark, str(tmp_path / "in"), fmt)
    assert sorted((r.seq, r.error) for r in read.collect()) == [(0, None), (1, None), (2, None), (3, None), (9, "EmptyChannelMask")]
    series = frames.to_series(read.filter("error is null"), ["session_id", "seq"]).select("session_id", "seq", "col", "x")
    decided = decide(series, ["session_id", "seq", "col"], [[500_000, 100, 5], [1_100_000, 300, 9]], 16, 8, artifact.ScreenLimits.amplitude_only(5000))
    keys = ["session_id", "seq", "col", "epoch_index"]
    io.write_decisions(decided, str(tmp_path / "out"), keys)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 * 2 * 3
    with pytest.raises(ValueError, match="samples may not leave"):
        io.write_decisions(read.select("seq", "samples"), str(tmp_path / "no"), ["seq"])


def test_stream_validates(spark, tmp_path):
    spark.createDataFrame([("s", 1, 1, 250, 1, [1, 2]), ("s", 2, 1, 250, 0, [1])], frames.FRAME).write.parquet(str(tmp_path / "in"))
    q = io.stream_frames(spark, str(tmp_path / "in")).select("seq", "error").writeStream.format("memory").queryName("frames_in").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.seq, r.error) for r in spark.table("frames_in").select("seq", F.col("error")).collect()) == [(1, None), (2, "EmptyChannelMask")]


def test_fixtures_of_json(spark, tmp_path):
    import json

    from wavemill.functions import fixed
    from wavemill.sources.synthetic import lcg_samples

    x = lcg_samples(128)
    frame = {"seq": 7, "timestamp_us": 1711540800000000, "sample_rate_hz": 250, "channel_mask": 255, "samples_per_channel": 16, "unit": "counts", "samples": x}
    (tmp_path / "a.json").write_text(json.dumps({"_meta": {"title": "t"}, "frame": frame}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"frame": frame | {"samples": x[:3]}}))
    df = io.read_fixtures(spark, str(tmp_path))
    rows = df.select("*", fixed.hex64(frames.checksum(F.col("seq"), F.col("timestamp_us"), F.col("rate_hz"), F.col("channel_mask"), F.col("samples_per_channel"), F.col("samples"))).alias("h")).orderBy(F.size("samples")).collect()
    assert [r.error for r in rows] == ["SampleLengthMismatch", None] and rows[1].samples == x and rows[1].samples_per_channel == 16
    assert rows[1].h == "0x875af1b082c94a2d"
