"""Overlapping time windows over long recordings."""

from pyspark.sql import functions as F

from parleyframe.functions.text import speaker_label
from parleyframe.schemas import UNKNOWN

# Fixed value: turns no longer than this (seconds) count as empty.
EMPTY_TURN_SECONDS = 1e-6


def _grid(chunk_minutes, overlap_seconds):
    length = int(round(chunk_minutes * 60 * 1000))
    step = length - int(round(overlap_seconds * 1000))
    if length <= 0 or step <= 0:
        raise ValueError("the overlap must be shorter than the chunk")
    return length, step


def chunk_windows(episodes, chunk_minutes=10, overlap_seconds=30):
    """Windows of each episode (episode_id, duration_ms): idx, start_ms, end_ms
    and the same bounds in seconds.

    A window starts wherever one fits before the end of the recording, so the
    last may lie inside the one before it.  An empty recording has none.
    """
    length, step = _grid(chunk_minutes, overlap_seconds)
    starts = F.when(
        F.col("duration_ms") > 0,
        F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(step).cast("long")))
    return (
        episodes.select("episode_id", "duration_ms", F.posexplode(starts).alias("idx", "start_ms"))
        .withColumn("end_ms", F.least(F.col("start_ms") + length, F.col("duration_ms")))
        .select(
            "episode_id", "idx", "start_ms", "end_ms",
            (F.col("start_ms") / 1000.0).alias("global_start"),
            (F.col("end_ms") / 1000.0).alias("global_end")))


def chunk_file(idx):
    return F.format_string("chunk_%03d.wav", idx)


def window_indexes(start, end, total, length, step):
    """Array of the windows of a grid that share time with [start, end).

    All arguments in one integer unit.  Computed from the grid, so content is
    attached to windows without a join.
    """
    first = F.greatest(F.lit(0), F.floor((start - length) / step) + 1)
    last = F.least(F.ceil(end / step), F.ceil(total / step)) - 1
    return F.when((start < end) & (last >= first), F.sequence(first, last))


def chunk_membership(content, chunk_minutes=10, overlap_seconds=30):
    """Attach content (episode_id, start_ms, end_ms, duration_ms, ...) to the
    windows it shares time with; content in an overlap belongs to two."""
    length, step = _grid(chunk_minutes, overlap_seconds)
    indexes = window_indexes(
        F.col("start_ms"), F.col("end_ms"), F.col("duration_ms"), length, step)
    return content.withColumn("idx", F.explode(indexes)).withColumn(
        "idx", F.col("idx").cast("int"))


def reference_chunks(chunks):
    """The first window of every episode."""
    return chunks.where(F.col("idx") == 0)


def globalize_turns(turns, chunks):
    """Move chunk-local turns (episode_id, chunk_idx, start, end) to episode time."""
    offsets = chunks.select(
        "episode_id", F.col("idx").alias("chunk_idx"), "global_start")
    return (
        turns.join(offsets, ["episode_id", "chunk_idx"])
        .withColumn("start", F.col("start") + F.col("global_start"))
        .withColumn("end", F.col("end") + F.col("global_start"))
        .drop("global_start"))


def dedup_turns(turns):
    """Of turns with equal bounds the last written label stays; empty turns go.

    ``turns`` (episode_id, start, end, chunk_idx, turn_pos, label) are taken in
    (chunk_idx, turn_pos) order.
    """
    return (
        turns.where(F.col("end") - F.col("start") > EMPTY_TURN_SECONDS)
        .groupBy("episode_id", "start", "end")
        .agg(F.max_by("label", F.struct("chunk_idx", "turn_pos")).alias("label")))


def with_speaker_label(turns):
    """Add ``speaker``; a turn without a label is UNKNOWN."""
    return turns.withColumn("speaker", F.when(
        F.col("label").isNotNull(), speaker_label(F.col("label"))).otherwise(UNKNOWN))


def windows_without_turns(chunks, turns):
    """Windows in which no turn was found."""
    seen = turns.select("episode_id", F.col("chunk_idx").alias("idx")).distinct()
    return chunks.join(seen, ["episode_id", "idx"], "left_anti")
