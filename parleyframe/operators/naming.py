"""Weighing, merging and applying proposed speaker names.

Proposals are rows (episode_id, pass, pos, speaker_id, proposed_name,
confidence, justification); ``pos`` is unique within (episode, pass).
"""

from pyspark.sql import functions as F

from parleyframe.functions.numbers import at_least
from parleyframe.schemas import UNKNOWN

THRESHOLD = 0.8
BEFORE_ALL = -(2 ** 62)


def conflict_flags(proposals, threshold=THRESHOLD):
    """(episode_id, pass, speaker_id, consistent).

    Taking proposals in ``pos`` order: an UNKNOWN is consistent when its
    confidence is at most the threshold; a name (ignoring case) belongs to the
    first speaker with a non-empty id who uses it, and another speaker using it
    later makes both inconsistent; the last such verdict on a speaker counts,
    and a speaker without one is consistent.

    Proposals are first reduced to one row per (name, speaker): the first and
    last use are all that matters.  All verdicts come out of one join of those
    rows with the owners of the names.
    """
    key = ["episode_id", "pass"]
    claims = proposals.groupBy(
        *key, F.when(F.upper("proposed_name") != UNKNOWN, F.lower("proposed_name")).alias("name"),
        "speaker_id").agg(
        F.min("pos").alias("first_use"), F.max("pos").alias("last_use"),
        F.max_by(F.col("confidence") <= threshold, "pos").alias("modest"))
    owners = (
        claims.where(F.col("name").isNotNull() & (F.col("speaker_id") != ""))
        .groupBy(*key, "name")
        .agg(F.min("first_use").alias("owned_from"),
             F.min_by("speaker_id", "first_use").alias("owner")))
    clash = F.coalesce(
        (F.col("speaker_id") != F.col("owner")) & (F.col("last_use") > F.col("owned_from")),
        F.lit(False))

    def verdict(speaker, pos, value):
        return F.struct(speaker.alias("speaker_id"), pos.alias("at"), value.alias("verdict"))

    speaker, last, no = F.col("speaker_id"), F.col("last_use"), F.lit(False)
    verdicts = F.concat(
        F.array(verdict(speaker, F.lit(BEFORE_ALL).cast("long"), F.lit(True))),
        F.when(F.col("name").isNull(), F.array(verdict(speaker, last, F.col("modest")))).when(
            clash, F.array(verdict(speaker, last, no), verdict(F.col("owner"), last, no)))
        .otherwise(F.array().cast("array<struct<speaker_id:string,at:bigint,verdict:boolean>>")))
    return claims.join(owners, [*key, "name"], "left").select(
        *key, F.inline(verdicts)).groupBy(*key, "speaker_id").agg(
        F.max_by("verdict", "at").alias("consistent"))


def consolidate(proposals):
    """The most confident proposal per speaker over all passes.

    The earlier one wins a tie.  A NaN confidence never replaces anything, and
    when it came first nothing replaces it.  ``first_pass`` and ``first_pos``
    tell when a speaker was first proposed, which orders the speakers.
    """
    row = F.struct("pass", "pos", "proposed_name", "confidence", "justification")
    ranked = (
        proposals.groupBy("episode_id", "speaker_id")
        .agg(F.min_by(row, F.struct("pass", "pos")).alias("first"),
             F.min_by(row, F.when(
                 ~F.isnan("confidence"), F.struct(-F.col("confidence"), "pass", "pos")))
             .alias("best")))
    kept = F.when(F.isnan("first.confidence") | F.col("best").isNull(), F.col("first")).otherwise(
        F.col("best"))
    return ranked.select(
        "episode_id", "speaker_id", kept["proposed_name"].alias("proposed_name"),
        kept["confidence"].alias("confidence"), kept["justification"].alias("justification"),
        F.col("first.pass").alias("first_pass"), F.col("first.pos").alias("first_pos"))


def is_high_confidence(threshold=THRESHOLD):
    return at_least(F.col("confidence"), threshold)


def unresolved_speakers(assignments, flags, threshold=THRESHOLD):
    """Assignments that are not confident enough or clash with another."""
    verdicts = flags.select("episode_id", "speaker_id", "consistent")
    return (
        assignments.join(verdicts, ["episode_id", "speaker_id"], "left")
        .where(~is_high_confidence(threshold) | ~F.coalesce("consistent", F.lit(True)))
        .drop("consistent"))


def finalize_assignments(assignments, threshold=THRESHOLD):
    """Names without enough confidence become UNKNOWN; the rest of the row stays."""
    return assignments.withColumn(
        "proposed_name",
        F.when(is_high_confidence(threshold), F.col("proposed_name")).otherwise(UNKNOWN))


def label_transcript(utterances, assignments, offset_seconds=0.0):
    """Add speaker_name, confidence and justification to every utterance.

    The assignments (a few rows per episode) are the small side: Spark
    broadcasts them if their measured size allows and otherwise splits a
    speaker or episode that holds much of the table.
    """
    names = assignments.select(
        "episode_id", F.col("speaker_id").alias("speaker"),
        F.col("proposed_name").alias("speaker_name"), "confidence", "justification")
    return (
        utterances.join(names, ["episode_id", "speaker"], "left")
        .select(
            "episode_id", "pos",
            (F.col("start") + float(offset_seconds)).alias("start"),
            (F.col("end") + float(offset_seconds)).alias("end"),
            "speaker", "text",
            F.coalesce("speaker_name", F.lit(UNKNOWN)).alias("speaker_name"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("justification", F.lit("")).alias("justification")))


def assignment_summary(assignments):
    return assignments.select("episode_id", "speaker_id", "proposed_name", "confidence")
