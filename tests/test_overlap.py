"""Overlap join and speaker assignment against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from parleyframe.operators.overlap import (
    _leveled, _placed, assign_speakers, episodes_without_turns, first_of_copies,
    overlap_join)

SEGMENTS = "episode_id string, pos long, start double, end double, text string"
TURNS = "episode_id string, line_no long, start double, end double, speaker string"


def best_by_hand(segments, turns, unknown="UNKNOWN"):
    result = {}
    for episode, pos, start, end, _ in segments:
        best = None
        for other, line, a, b, speaker in sorted(turns, key=lambda t: t[1]):
            shared = min(end, b) - max(start, a)
            if other == episode and min(end, b) > max(start, a) and (
                    best is None or shared > best[0]):
                best = (shared, speaker)
        result[episode, pos] = best[1] if best else unknown
    return result


def assigned(spark, segments, turns, **options):
    frame = assign_speakers(
        spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns, TURNS), **options)
    return {(r.episode_id, r.pos): r.speaker for r in frame.collect()}


def test_cases(spark):
    def turns(episode, *rows):
        return [(episode, i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)]
    segments = [("longest", 0, 0.0, 4.0, "t"), ("tie", 0, 0.0, 4.0, "t"),
                ("empty", 0, 2.0, 2.0, "t"), ("touching", 0, 0.0, 2.0, "t"),
                ("inverted", 0, 5.0, 1.0, "t"), ("none", 0, 0.0, 1.0, "t")]
    spoken = (
        turns("longest", (0, 1, "A"), (1, 2.5, "A"), (2, 4, "B"))
        + turns("tie", (0, 2, "A"), (2, 4, "B")) + turns("empty", (0, 4, "A"))
        + turns("touching", (2, 4, "A")) + turns("inverted", (0, 9, "A"), (8, 0, "B")))
    assert assigned(spark, segments, spoken) == {
        ("longest", 0): "B", ("tie", 0): "A", ("empty", 0): "UNKNOWN",
        ("touching", 0): "UNKNOWN", ("inverted", 0): "UNKNOWN", ("none", 0): "UNKNOWN"}
    assert assigned(spark, segments[:1], [], unknown_label="?") == {("longest", 0): "?"}


@pytest.mark.parametrize("seed,span,bucket", [
    (1, 40, 1.0), (2, 40, 60.0), (3, 4000, 7.5), (4, 1000, 0.3)])
def test_random_against_brute_force(spark, seed, span, bucket):
    pick = random.Random(seed)

    def interval():
        start = pick.randrange(-span // 4, span) / pick.choice([1, 2, 10])
        return start, start + pick.randrange(-2, 40) / pick.choice([1, 4])
    segments = [(e, i, *interval(), f"{e}{i}") for e in "ab" for i in range(60)]
    turns = [(e, i, *interval(), f"S{pick.randrange(4)}") for e in "ab" for i in range(60)]
    turns += [(e, 100 + i, a, b, "copy") for e, i, a, b, _ in turns[::3]]
    assert assigned(spark, segments, turns, bucket_seconds=bucket) == best_by_hand(segments, turns)
    pairs = overlap_join(
        spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns, TURNS), bucket)
    found = sorted((r.episode_id, r.pos, r.line_no, round(r.overlap, 9)) for r in pairs.collect())
    assert found == sorted(
        (e, p, n, round(min(end, b) - max(start, a), 9))
        for e, p, start, end, _ in segments for o, n, a, b, _ in turns
        if e == o and min(end, b) > max(start, a))


def test_order_of_input_does_not_matter(spark):
    pick = random.Random(9)
    segments = [("a", i, i * 2.0, i * 2.0 + 3, "t") for i in range(300)]
    turns = [("a", i, i * 1.0, i * 1.0 + pick.choice([1, 2]), f"S{i % 5}") for i in range(600)]
    once = assigned(spark, segments, turns)
    pick.shuffle(segments), pick.shuffle(turns)
    frame = assign_speakers(
        spark.createDataFrame(segments, SEGMENTS).repartition(5, "text"),
        spark.createDataFrame(turns, TURNS).repartition(7))
    assert {(r.episode_id, r.pos): r.speaker for r in frame.collect()} == once


def test_infinite_or_nan_bounds(spark):
    nan = float("nan")
    segments = [("a", 0, 0.0, 4.0, "t"), ("a", 1, nan, 4.0, "t"), ("a", 2, 0.0, nan, "t")]
    turns = [("a", 0, 0.0, nan, "A"), ("a", 1, nan, 3.0, "B"), ("a", 2, 3.0, 4.0, "C")]
    assert assigned(spark, segments, turns) == {
        ("a", 0): "C", ("a", 1): "UNKNOWN", ("a", 2): "UNKNOWN"}


@pytest.mark.parametrize("bucket", [60.0, 0.01])
def test_long_and_unbounded_intervals(spark, bucket):
    inf = float("inf")
    pick = random.Random(3)
    lengths = [0.5, 59, 100, 4000, 86400, 3e5, 1e12, inf]
    rows = [(pick.randrange(-500, 90000) / 2, pick.choice(lengths)) for _ in range(120)]
    segments = [("e", i, a, a + n, "t") for i, (a, n) in enumerate(rows[:60])]
    turns = [("e", i, -inf if i % 17 == 0 else a, a + n, f"S{i}") for i, (a, n) in enumerate(rows[60:])]
    pairs = overlap_join(
        spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns, TURNS), bucket)
    found = sorted((r.pos, r.line_no) for r in pairs.collect())
    assert found == sorted((p, n) for _, p, start, end, _ in segments for _, n, a, b, _ in turns
                           if min(end, b) > max(start, a))


def test_first_of_copies(spark, rows):
    turns = spark.createDataFrame(
        [("a", 3, 0.0, 1.0, "A"), ("a", 1, 0.0, 1.0, "A"), ("a", 2, 0.0, 2.0, "A"),
         ("a", 4, 0.0, 1.0, "B")], TURNS)
    assert rows(first_of_copies(turns), "line_no", "speaker") == [(1, "A"), (2, "A"), (4, "B")]


def test_episodes_without_turns(spark, rows):
    episodes = spark.createDataFrame([("a",), ("b",)], "episode_id string")
    turns = spark.createDataFrame([("a", 0, 0.0, 1.0, "A")] * 3, TURNS)
    assert rows(episodes_without_turns(episodes, turns)) == [("b",)]


def test_plan_has_no_pairwise_join(spark):
    segments = spark.range(1000).select(
        F.lit("a").alias("episode_id"), F.col("id").alias("pos"),
        F.col("id").cast("double").alias("start"), (F.col("id") + 1.0).alias("end"),
        F.lit("t").alias("text"))
    turns = segments.selectExpr("episode_id", "pos line_no", "start", "end", "'A' speaker")
    for threshold in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            plan = assign_speakers(segments, turns)._jdf.queryExecution().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_copies_only_where_wide_intervals_are(spark):
    """A short interval has at most two rows, and one more where a wide one stands."""
    segments = _leveled(spark.createDataFrame(
        [(e, i, i * 30.0, i * 30.0 + 45, "t") for e in "ab" for i in range(500)], SEGMENTS), "pos", 60.0)
    short = [(e, i, i * 20.0, i * 20.0 + 60, "A") for e in "ab" for i in range(700)]

    def rows_of(turns):
        turns = _leveled(spark.createDataFrame(turns, TURNS), "line_no", 60.0)
        placed = _placed(segments, turns, 60.0).cache()
        home = placed.where("level = own").groupBy("episode_id", "pos").count()
        return (home.agg(F.max("count")).first()[0],
                placed.where("level > own").select("episode_id", "pos", "level").collect())
    assert rows_of(short) == (2, [])
    # A turn of five minutes: level 1, the first bucket of 64 minutes of one episode.
    most, above = rows_of([*short, ("a", 900, 100.0, 400.0, "B")])
    assert most == 2
    assert {(r.episode_id, r.level) for r in above} == {("a", 1)}
    assert sorted(r.pos for r in above) == [i for i in range(500) if i * 30 < 64 * 60]
