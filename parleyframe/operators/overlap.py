"""Who speaks when a transcript segment is spoken."""

from pyspark.sql import functions as F

from parleyframe.functions.intervals import overlap, proper
from parleyframe.schemas import UNKNOWN

BUCKET_SECONDS = 60.0
# Each level's buckets are so many times wider than those of the level below it;
# the top level is one bucket without bounds.
WIDER, TOP = 64, 3
# A wide bucket is dealt out: short intervals to one part each, wide ones to all.
PARTS = 16
# Bits of the bitmap of buckets with wide intervals; the size Spark builds at once.
FILTER_BITS = 32768


KEY = ("episode_id", "level", "bucket", "part")


def _leveled(table, number, width):
    """Intervals with their ``own`` level and their first bucket on every level.

    The own level is the first whose buckets are as wide as the interval is long.
    An interval that is empty, inverted or not a number overlaps nothing.
    """
    length = F.col("end") - F.col("start")
    own = sum(((length > width * WIDER ** level).cast("int") for level in range(TOP)), F.lit(0))
    return (
        table.where(proper(F.col("start"), F.col("end")))
        .withColumn("own", own)
        .withColumn("dealt", F.pmod(F.hash(number), F.lit(PARTS))))


def _at_level(bound, width):
    """The bucket of a bound on the row's level; the top level has one."""
    return F.when(F.col("level") == TOP, F.lit(0).cast("long")).otherwise(
        F.floor(bound / (width * F.pow(F.lit(float(WIDER)), F.col("level")))))


def _in_buckets(leveled, width):
    """A row for every bucket the interval touches on the row's level, at most two."""
    return (
        leveled.withColumn("home", _at_level(F.col("start"), width))
        .withColumn("bucket", F.explode(F.sequence("home", _at_level(F.col("end"), width)))))


def _bit():
    return F.pmod(F.xxhash64("episode_id", "level", "bucket"), F.lit(FILTER_BITS))


def _wide_filter(leveled, width):
    """One bitmap of fixed size: the buckets where wide intervals are at home."""
    wide = _in_buckets(leveled.where(F.col("own") > 0).withColumn(
        "level", F.explode(F.array("own"))), width)
    return wide.agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit() + 1)).alias("bits"))


def _placed(leveled, others, width):
    """One row per bucket and part: of the own level, and of those above only where
    ``others`` may have a wide interval at home (a bitmap tells, without a join).

    Wide intervals go to all parts of their own level, copies to one each.
    """
    byte = F.substring(_wide_filter(others, width).scalar(),
                       (_bit() / 8).cast("int") + 1, F.lit(1))
    set_ = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (_bit() % 8).cast("int")) == 1
    at_home = F.col("level") == F.col("own")
    parts = F.when(~at_home, F.array("dealt")).when(F.col("own") == 0, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.lit(PARTS - 1)))
    return (
        _in_buckets(leveled.withColumn(
            "level", F.explode(F.sequence("own", F.lit(TOP)))), width)
        .where(at_home | set_)
        .withColumn("part", F.explode(parts)))


def overlap_join(segments, turns, bucket_seconds=BUCKET_SECONDS):
    """All pairs of a segment and a turn of one episode that share time.

    ``segments`` (episode_id, pos, start, end) and ``turns`` (episode_id,
    line_no, start, end, speaker) give (episode_id, pos, line_no, speaker,
    overlap).  A pair meets on the level of the longer of the two, in an
    equi-join on (episode, level, bucket, part), so one very long recording is
    many join keys and the work grows with the neighbours of a segment, not with
    the recording.  A pair that shares several buckets is kept only in the first,
    where the later of the two starts.  Bounds may be infinite.
    """
    a = _leveled(segments.select("episode_id", "pos", "start", "end"), "pos", bucket_seconds)
    b = _leveled(turns.select("episode_id", "line_no", "start", "end", "speaker"), "line_no",
                 bucket_seconds)

    place = (*KEY, "own", "home", "start", "end")
    theirs = _placed(b, a, bucket_seconds).select(*place, "line_no", "speaker").withColumnsRenamed(
        {name: f"turn_{name}" for name in place})
    same = F.lit(True)
    for name in KEY:
        same &= F.col(name) == F.col(f"turn_{name}")
    return _placed(a, b, bucket_seconds).select(*place, "pos").join(
        theirs,
        same & (F.col("level") == F.greatest("own", "turn_own"))
        & (F.col("bucket") == F.greatest("home", "turn_home"))
        # Two wide intervals meet in every part.
        & ((F.col("own") != F.col("turn_own")) | (F.col("part") == 0))
        & (F.col("start") < F.col("turn_end")) & (F.col("turn_start") < F.col("end")),
    ).select(
        "episode_id", "pos", "line_no", "speaker",
        overlap(F.col("start"), F.col("end"), F.col("turn_start"), F.col("turn_end"))
        .alias("overlap"))


def first_of_copies(turns):
    """Of a speaker's turns with equal bounds only the first line can win a segment."""
    return (
        turns.groupBy("episode_id", "start", "end", "speaker")
        .agg(F.min("line_no").alias("line_no")))


def assign_speakers(transcript, turns, unknown_label=UNKNOWN, bucket_seconds=BUCKET_SECONDS):
    """Give each transcript row the speaker of the longest single overlap.

    Ties go to the turn that comes first in the diarization; a row that no turn
    overlaps gets ``unknown_label``.  Only keys and bounds travel through the
    join; the texts are joined back at the end on the unique row key.
    """
    pairs = overlap_join(transcript, first_of_copies(turns), bucket_seconds)
    winners = pairs.groupBy("episode_id", "pos").agg(
        F.min_by("speaker", F.struct(-F.col("overlap"), "line_no")).alias("speaker"))
    return transcript.join(winners, ["episode_id", "pos"], "left").select(
        "episode_id", "pos", "start", "end",
        F.coalesce("speaker", F.lit(unknown_label)).alias("speaker"), "text")


def episodes_without_turns(episodes, turns):
    """Episodes the diarization says nothing about."""
    known = turns.select("episode_id").distinct()
    return episodes.join(known, "episode_id", "left_anti")


def require_turns(transcript, turns):
    """The transcript; the job fails at the first row whose episode has no turns."""
    known = turns.select("episode_id").distinct().withColumn("_known", F.lit(True))
    complaint = F.concat(F.lit("no diarization segments for episode "), F.col("episode_id"))
    return transcript.join(known, "episode_id", "left").where(
        F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    ).drop("_known")
