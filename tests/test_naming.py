"""Conflict check, merging and labelling."""

import math
import random

from pyspark.sql import functions as F

from parleyframe.operators import naming

PROPOSALS = ("episode_id string, pass int, pos long, speaker_id string, proposed_name string, "
             "confidence double, justification string")


def frame_of(spark, groups):
    """{episode: [(speaker, name, confidence)]} as proposals of pass 1."""
    return spark.createDataFrame(
        [(e, 1, i, *row, f"{e}{i}") for e, rows in groups.items() for i, row in enumerate(rows)],
        PROPOSALS)


def verdicts_by_hand(rows):
    verdict, owners = {}, {}
    for speaker, name, confidence in rows:
        if name.upper() == "UNKNOWN":
            verdict[speaker] = confidence <= 0.8
            continue
        owner = owners.get(name.lower())
        if owner and owner != speaker:
            verdict[speaker] = verdict[owner] = False
        else:
            owners[name.lower()] = speaker
            verdict.setdefault(speaker, True)
    return verdict


def test_conflict_cases(spark):
    groups = {
        "clash": [("A", "Bob", .9), ("B", "bob", .9)],
        "unknown": [("A", "UNKNOWN", .8), ("B", "UNKNOWN", .9)],
        "late": [("A", "Bob", .9), ("B", "bob", .9), ("A", "UNKNOWN", .1)],
        "empty": [("", "Bob", .9), ("A", "Bob", .9), ("B", "Bob", .9)],
        "nan": [("A", "unknown", float("nan"))],
    }
    found = {}
    for r in naming.conflict_flags(frame_of(spark, groups)).collect():
        found.setdefault(r.episode_id, {})[r.speaker_id] = r.consistent
    assert found == {
        "clash": {"A": False, "B": False}, "unknown": {"A": True, "B": False},
        "late": {"A": True, "B": False}, "empty": {"": True, "A": False, "B": False},
        "nan": {"A": False}}


def test_conflicts_match_the_rules_in_sequence(spark):
    pick = random.Random(3)
    groups = {
        f"g{k}": [(pick.choice(["", "A", "B", "C", "D"]),
                   pick.choice(["Ann", "ann", "Bob", "unknown", "UNKNOWN", "Eve"]),
                   pick.choice([0.1, 0.8, 0.81, 0.9])) for _ in range(pick.randrange(1, 12))]
        for k in range(600)}
    found = {}
    for r in naming.conflict_flags(frame_of(spark, groups)).collect():
        found.setdefault(r.episode_id, {})[r.speaker_id] = r.consistent
    assert found == {k: verdicts_by_hand(rows) for k, rows in groups.items()}


def test_consolidation_in_sequence(spark):
    pick = random.Random(4)
    nan = float("nan")
    rows = [
        (f"g{k}", p, i, pick.choice("AB"), f"n{i}", pick.choice([0.0, -0.0, .5, .9, nan]), f"{p}{i}")
        for k in range(400) for p in (1, 2) for i in range(pick.randrange(5))]
    merged = {}
    for episode, p, i, speaker, name, confidence, why in rows:
        current = merged.get((episode, speaker))
        if current is None or confidence > current[1]:
            first = (p, i) if current is None else current[3]
            merged[episode, speaker] = (name, confidence, why, first)
    frame = spark.createDataFrame(rows, PROPOSALS).repartition(6)
    found = {
        (r.episode_id, r.speaker_id): (
            r.proposed_name, r.confidence, r.justification, (r.first_pass, r.first_pos))
        for r in naming.consolidate(frame).collect()}
    assert repr(sorted(found.items())) == repr(sorted(merged.items()))
    again = naming.consolidate(naming.consolidate(frame).select(
        "episode_id", F.col("first_pass").alias("pass"), F.col("first_pos").alias("pos"),
        "speaker_id", "proposed_name", "confidence", "justification"))
    assert {(r.episode_id, r.speaker_id): r.justification for r in again.collect()} == {
        key: value[2] for key, value in merged.items()}


def test_earlier_wins_a_tie(spark):
    frame = spark.createDataFrame(
        [("e", 2, 0, "A", "Amy", .5, "new"), ("e", 1, 3, "A", "Ann", .5, "prior")], PROPOSALS)
    assert naming.consolidate(frame).first().proposed_name == "Ann"


def test_unresolved_and_final(spark, rows):
    nan = float("nan")
    merged = spark.createDataFrame(
        [("e", "A", "Ann", .8, "j"), ("e", "B", "Bob", .79, "j"), ("e", "C", "Cy", nan, "j"),
         ("e", "D", "Dee", .9, "j"), ("e", "E", "UNKNOWN", .8, "j")],
        "episode_id string, speaker_id string, proposed_name string, confidence double, "
        "justification string")
    flags = spark.createDataFrame(
        [("e", 1, "D", False), ("e", 1, "A", True)],
        "episode_id string, pass int, speaker_id string, consistent boolean")
    assert rows(naming.unresolved_speakers(merged, flags), "speaker_id") == [("B",), ("C",), ("D",)]
    final = {r.speaker_id: r for r in naming.finalize_assignments(merged).collect()}
    assert {k: r.proposed_name for k, r in final.items()} == {
        "A": "Ann", "B": "UNKNOWN", "C": "UNKNOWN", "D": "Dee", "E": "UNKNOWN"}
    assert final["B"].confidence == .79 and math.isnan(final["C"].confidence)


def test_labels(spark, rows):
    utterances = spark.createDataFrame(
        [("e", 0, 1.0, 2.0, "A", "x"), ("e", 1, 2.0, 3.0, "B", "y"), ("f", 0, 0.0, 1.0, "A", "z")],
        "episode_id string, pos long, start double, end double, speaker string, text string")
    names = spark.createDataFrame(
        [("e", "A", "Ann", .9, "why")],
        "episode_id string, speaker_id string, proposed_name string, confidence double, "
        "justification string")
    assert rows(naming.label_transcript(utterances, names, 10)) == [
        ("e", 0, 11.0, 12.0, "A", "x", "Ann", .9, "why"),
        ("e", 1, 12.0, 13.0, "B", "y", "UNKNOWN", 0.0, ""),
        ("f", 0, 10.0, 11.0, "A", "z", "UNKNOWN", 0.0, "")]


def test_verdicts_need_two_evaluations_of_the_proposals(spark, tmp_path):
    spark.createDataFrame(
        [("e", 1, 0, "A", "Ann", 0.9, "")],
        "episode_id string, pass int, pos long, speaker_id string, proposed_name string, "
        "confidence double, justification string").write.parquet(str(tmp_path / "p"))
    flags = naming.conflict_flags(spark.read.parquet(str(tmp_path / "p")))
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") <= 5
