"""Profiles, quotes, rosters and prompts."""

import pytest
from pyspark.sql import functions as F

from parleyframe.functions.prompts import SECOND_ROUND, context_summary
from parleyframe.operators import evidence, prompting, roster

UTTERANCES = "episode_id string, pos long, start double, end double, speaker string, text string"


def utterances(spark, *texts, speaker="A", episode="e"):
    return spark.createDataFrame(
        [(episode, i, float(i), i + 0.5, speaker, t) for i, t in enumerate(texts)], UTTERANCES)


def quotes(spark, n, m, *texts):
    rows = evidence.quote_rows(utterances(spark, *texts), n, m)
    return [r.text for r in rows.orderBy("part", "start", "pos").collect()]


def test_quotes_repeat_when_samples_meet(spark):
    assert quotes(spark, 2, 2, "a", "b", "c") == ["a", "b", "b", "c"]
    assert quotes(spark, 2, 0, "a", "b", "c") == ["a", "b", "a", "b", "c"]
    assert quotes(spark, 5, 5, "a") == ["a", "a"]
    assert quotes(spark, 1, 1, *"abcdef") == ["a", "f"]


def test_quote_arrays_of_size_zero(spark):
    said = utterances(spark, "a", "b", "c")
    for n, m, expected in ((2, 0, "ababc"), (0, 0, "abc"), (0, 1, "c")):
        assert evidence.sample_quotes(said, n, m).first().sample_quotes == list(expected)
    assert evidence.speaker_profiles(said, 0, 1).first().first_pos == 0


def test_first_rows_over_many_partitions(spark):
    table = spark.range(0, 20000, 1, 40).select(
        (F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 20011).alias("x"))
    found = {}
    for r in evidence.first_rows(table, ["k"], ["x"], 4, shards=8).collect():
        found.setdefault(r.k, []).append(r.x)
    expected = {k: sorted((i * 7919) % 20011 for i in range(k, 20000, 3))[:4] for k in range(3)}
    assert {k: sorted(v) for k, v in found.items()} == expected


def test_rank_is_limited_before_the_shuffle(spark):
    rows = evidence.quote_rows(utterances(spark, "a", "b"), 50, 50)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 4 and plan.count("WindowGroupLimit") >= 8


def test_profiles(spark):
    said = spark.createDataFrame(
        [("e", 0, 5.0, 6.0, "B", "late"), ("e", 1, 1.0, 2.5, "B", "early"),
         ("e", 2, 1.0, 0.0, "A", "backwards"), ("f", 0, 0.0, 9.0, "A", "other")], UTTERANCES)
    found = {(r.episode_id, r.speaker_id): r for r in evidence.speaker_profiles(said).collect()}
    b = found["e", "B"]
    assert (b.total_duration, b.total_turns, b.first_start, b.last_end, b.first_pos) == (
        2.5, 2, 1.0, 6.0, 1)
    assert b.sample_quotes == ["early", "late", "early", "late"]
    assert found["e", "A"].total_duration == 0.0 and len(found) == 3


def test_roster(spark):
    frame = spark.createDataFrame(
        [(" - x", ["Zed"]), (" Show - 1", ["Al", "Al"]), ("  ", None)],
        "name string, people array<string>")
    names = roster.candidate_roster(F.col("name"), F.col("people"), ["Al"])
    assert [r.n for r in frame.select(names.alias("n")).collect()] == [
        ["Al", "Unknown Guest", "Unknown Host", "Zed"],
        ["Al", "Show", "Unknown Guest", "Unknown Host"],
        ["", "Al", "Unknown Guest", "Unknown Host"]]


def test_people(spark):
    frame = spark.createDataFrame(
        [([("Zoe ", "PERSON"), ("Acme", "ORG"), ("Al", "PERSON"), ("Zoe", "PERSON")],), ([],)],
        "entities array<struct<text:string,label:string>>")
    people = roster.people_from_entities(F.col("entities"))
    assert [r.p for r in frame.select(people.alias("p")).collect()] == [["Al", "Zoe"], []]


PROFILES = ("episode_id string, speaker_id string, total_duration double, total_turns long, "
            "first_start double, last_end double, sample_quotes array<string>, first_pos long")


def profiles(spark, speakers, episode="e"):
    return spark.createDataFrame(
        [(episode, s, 0.25, 2, 0.35, 10.0, ["x", "y"], i) for i, s in enumerate(speakers)], PROFILES)


CONTEXT = "episode_id string, candidate_names array<string>, context string"


def test_prompt_layout(spark):
    about = spark.createDataFrame([("e", ["Al", "Bo"], "Title: T")], CONTEXT)
    prompts = prompting.build_prompts(profiles(spark, ["Z", "A"]), about).collect()
    assert len(prompts) == 1
    block = ("Speaker: {}\ntotal_duration_sec: 0.2\nturn_count: 2\nfirst_start_sec: 0.3\n"
             "last_end_sec: 10.0\nQuotes:\n- \"x\"\n- \"y\"\n")
    assert prompts[0].prompt.endswith(
        "\nEpisode Context:\nTitle: T\n\nCandidate Names: Al, Bo\n\nSpeaker Evidence:\n"
        + block.format("Z") + "\n\n" + block.format("A") + "\n")


def test_prompt_without_names(spark):
    about = spark.createDataFrame([("e", [], "c")], CONTEXT)
    assert "Candidate Names: Unknown\n" in prompting.build_prompts(
        profiles(spark, ["A"]), about).first().prompt


def test_many_speakers_are_one_prompt(spark):
    speakers = [f"S{i:04d}" for i in range(1000)]
    about = spark.createDataFrame([("e", [], "c")], CONTEXT)
    (prompt,) = prompting.build_prompts(
        profiles(spark, speakers), about, instructions="Who?\n").collect()
    assert prompt.prompt.startswith("Who?\n\nEpisode Context:")
    assert [line[9:] for line in prompt.prompt.split("\n") if line.startswith("Speaker: ")] == speakers


def test_targets(spark, rows):
    targets = spark.createDataFrame(
        [("e", "B", 0), ("e", "ghost", 1)], "episode_id string, speaker_id string, target_pos int")
    known = profiles(spark, ["A", "B"])
    assert rows(prompting.refine_targets(known, targets), "speaker_id", "target_pos") == [("B", 0)]
    assert rows(prompting.unknown_targets(known, targets), "speaker_id") == [("ghost",)]
    with pytest.raises(Exception, match="no profile for speaker ghost"):
        prompting.refine_targets(known, targets, strict=True).collect()


def test_context(spark):
    frame = spark.createDataFrame([("N", " a b\nc "), ("M", "")], "name string, description string")
    shown = frame.select(context_summary(F.col("name"), F.col("description"), 2).alias("c")).collect()
    assert [r.c for r in shown] == ["Title: N\nDescription: a b", "Title: M\nDescription: "]
    assert SECOND_ROUND.startswith("\n")
