"""Windows over time and over samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleyframe.operators import audio, chunks, models
from parleyframe.operators.models import Model

PCM = "episode_id string, channel int, block long, sample_rate int, samples array<float>"


def pcm(spark, waves, block, rate):
    """{episode: [channel arrays]} as blocks."""
    return spark.createDataFrame(
        [(e, c, b, rate, [float(x) for x in wave[b * block:(b + 1) * block]])
         for e, channels in waves.items() for c, wave in enumerate(channels)
         for b in range(-(-len(wave) // block))], PCM)


def windows(spark, ms, minutes=10, overlap=30):
    frame = spark.createDataFrame([("e", ms)], "episode_id string, duration_ms long")
    return [(r.idx, r.global_start, r.global_end)
            for r in chunks.chunk_windows(frame, minutes, overlap).orderBy("idx").collect()]


def test_windows(spark):
    assert windows(spark, 600_000) == [(0, 0.0, 600.0), (1, 570.0, 600.0)]
    assert windows(spark, 570_000) == [(0, 0.0, 570.0)]
    assert windows(spark, 1) == [(0, 0.0, 0.001)]
    assert windows(spark, 0) == []
    assert len(windows(spark, 5_700_001)) == 11
    with pytest.raises(ValueError):
        windows(spark, 1, 1, 60)


def test_membership_matches_windows(spark):
    content = [(s, s + d) for s in range(0, 3000, 37) for d in (0, 1, 99, 700)]
    frame = spark.createDataFrame(
        [("e", s, min(t, 3000), 3000) for s, t in content],
        "episode_id string, start_ms long, end_ms long, duration_ms long")
    found = sorted((r.start_ms, r.end_ms, r.idx) for r in chunks.chunk_membership(
        frame, 1 / 60, 0.25).collect())
    grid = [(i, w, min(w + 1000, 3000)) for i, w in enumerate(range(0, 3000, 750))]
    assert found == sorted(
        (s, min(t, 3000), i) for s, t in content for i, low, high in grid
        if s < min(t, 3000) and s < high and min(t, 3000) > low)


def test_last_write_wins(spark, rows):
    turns = spark.createDataFrame(
        [("e", 1.0, 2.0, 0, 5, 1), ("e", 1.0, 2.0, 1, 0, 2), ("e", 1.0, 2.0, 0, 9, 3),
         ("e", 3.0, 3.0, 0, 0, 4), ("e", 4.0, 3.0, 0, 0, 5)],
        "episode_id string, start double, end double, chunk_idx int, turn_pos long, label int")
    assert rows(chunks.dedup_turns(turns), "start", "label") == [(1.0, 2)]


def test_labels_are_not_cut(spark, rows):
    frame = spark.createDataFrame([(3,), (123,)], "label int")
    assert rows(chunks.with_speaker_label(frame), "speaker") == [("SPEAKER_03",), ("SPEAKER_123",)]


@pytest.mark.parametrize("start,length", [(0, 100), (1, 1), (2, 3), (4, 9), (7, 1), (0, 0)])
@pytest.mark.parametrize("named", [None, 10])
def test_clip(spark, start, length, named):
    wave = np.arange(53)
    table = pcm(spark, {"e": [wave, wave + 100]}, 8, 10)
    found = {}
    for r in audio.clip_pcm(table, start, length, 8, named).collect():
        for i, x in enumerate(r.samples):
            found[r.channel, r.first_sample + i] = x
    expected = {(c, i): x + 100 * c for c in (0, 1)
                for i, x in enumerate(wave[start * 10:(start + length) * 10])}
    assert found == expected


def test_clip_filter_reaches_the_scan(spark, tmp_path):
    pcm(spark, {"e": [np.arange(30)]}, 8, 10).write.parquet(str(tmp_path / "pcm"))
    table = spark.read.schema(PCM).parquet(str(tmp_path / "pcm"))
    plan = audio.clip_pcm(table, 1, 1, 8, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block,1)" in plan.replace(" ", "")


def test_mixdown(spark):
    rng = np.random.default_rng(0)
    left, right, third = rng.normal(size=(3, 37)).astype("float32")
    table = pcm(spark, {"two": [left, right], "one": [left], "three": [left, right, third]}, 8, 10)
    found = {}
    for r in audio.mixdown_pcm(table).collect():
        for i, x in enumerate(r.samples):
            found[r.episode_id, r.block * 8 + i] = x
    for name, wave in (("one", left), ("two", (left.astype("float64") + right) / 2),
                       ("three", (left.astype("float64") + right + third) / 3)):
        assert [found[name, i] for i in range(37)] == [float(np.float32(x)) for x in wave]


def test_duration(spark, rows):
    table = pcm(spark, {"a": [np.zeros(25), np.zeros(25)], "b": [np.zeros(3)]}, 8, 10)
    assert rows(audio.audio_duration(table)) == [("a", 25, 10, 2.5), ("b", 3, 10, 0.3)]
    slim = table.withColumn("n_samples", F.size("samples")).drop("samples")
    assert rows(audio.audio_duration(slim)) == [("a", 25, 10, 2.5), ("b", 3, 10, 0.3)]


def test_duration_is_that_of_the_longest_channel(spark, rows, tmp_path):
    table = pcm(spark, {"a": [np.zeros(5), np.zeros(25)]}, 8, 10).withColumn(
        "channel", F.col("channel") + 1)
    assert rows(audio.audio_duration(table)) == [("a", 25, 10, 2.5)]
    table.withColumn("n_samples", F.size("samples")).write.parquet(str(tmp_path / "pcm"))
    plan = audio.audio_duration(spark.read.parquet(str(tmp_path / "pcm")))
    scan = plan._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "n_samples" in scan and "<samples" not in scan and ",samples" not in scan


def test_a_missing_block_does_not_halve_the_others(spark):
    left, right = np.arange(16) + 1.0, np.arange(8) + 3.0
    table = pcm(spark, {"e": [left, right]}, 8, 10)
    expected = [*((left[:8] + right) / 2), *left[8:]]
    found = {}
    for r in audio.mixdown_pcm(table).collect():
        found.update({r.block * 8 + i: x for i, x in enumerate(r.samples)})
    assert [found[i] for i in range(16)] == expected
    pieces = audio.chunk_audio(table, 8, 1, 0)
    (row,) = models.transcribe_windows(pieces, REPORT, 60_000, tick_factor=10).collect()
    assert [float(x) for x in row.text.strip("[]").split(",")] == expected


def load_report():
    return lambda samples, rate: [(0, 1, str(samples.round(3).tolist()))]


REPORT = Model("window report", load_report)


def test_window_audio_is_assembled_and_mixed(spark):
    left, right = np.arange(53), np.arange(53) * 3
    table = pcm(spark, {"e": [left, right], "m": [left]}, 8, 10)
    pieces = audio.chunk_audio(table, 8, 2 / 60, 0.5)  # 20 samples every 15
    found = {}
    for r in models.transcribe_windows(pieces, REPORT, 1500, tick_factor=10).collect():
        found[r.episode_id, r.start] = [float(x) for x in r.text.strip("[]").split(",")]
    expected = {}
    for name, wave in (("e", (left + right) / 2), ("m", left)):
        for k in range(4):
            expected[name, 1.5 * k] = wave[15 * k:15 * k + 20].tolist()
    assert found == expected


def test_written_windows(spark, tmp_path):
    pieces = audio.chunk_audio(pcm(spark, {"e": [np.arange(53)]}, 8, 10), 8, 2 / 60, 0.5)
    audio.write_chunk_audio(pieces, str(tmp_path / "w"))
    back = spark.read.parquet(str(tmp_path / "w"))
    assert back.agg(F.sum(F.size("samples"))).first()[0] == 20 + 20 + 20 + 8
    assert chunks.chunk_file(F.lit(7)) is not None


def test_mixing_in_parts_is_mixing_at_once():
    rng = np.random.default_rng(3)
    slices = [(int(rng.integers(0, 900)), rng.normal(size=int(rng.integers(0, 200))).astype("float32"))
              for _ in range(60)]
    total, seen = np.zeros(1100), np.zeros(1100)
    for first, x in slices:
        total[first:first + len(x)] += x
        seen[first:first + len(x)] += 1
    length = max(first + len(x) for first, x in slices)
    expected = (total / np.maximum(seen, 1)).astype("float32")[:length]
    for at_once in (1, 7, 64, 10_000):
        assert np.array_equal(audio.mixed(slices, at_once), expected)
    assert len(audio.mixed([])) == 0


def test_mixing_half_an_hour_holds_one_array():
    import tracemalloc
    rate, seconds = 16_000, 1800
    blocks = [(rate * s, np.full(rate, s % 2, "float32")) for s in range(seconds)]
    tracemalloc.start()
    wave = audio.mixed(blocks * 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert wave[rate * 7] == 1 and len(wave) == rate * seconds
    # With the samples that came in, under three times the samples that go out.
    assert peak < 1.25 * wave.nbytes
