"""Speaker turns as RTTM lines.

``SPEAKER <recording> <channel> <start> <duration> <ortho> <type> <name> <conf> <lookahead>``
"""

from pyspark.sql import functions as F

from parleyframe.functions.numbers import parse_float, required, sum_of_texts
from parleyframe.functions.text import SPACE_RUN, fixed, strip, words
from parleyframe.sources.lines import (
    computed_once, ordered_lines, settled_while, write_lines)

FAILFAST, PERMISSIVE, DROPMALFORMED = "FAILFAST", "PERMISSIVE", "DROPMALFORMED"

# Fields a line needs, and where the used ones are (from 1).
FIELDS_NEEDED = 9
RECORDING_FIELD, START_FIELD, DURATION_FIELD, SPEAKER_FIELD = 2, 4, 5, 8


def parse_rttm(lines, mode=FAILFAST, episode_from_line=False, exact=False):
    """Parse (episode_id, line_no, value) into speaker turns.

    Blank lines and ``#`` comments are skipped.  A malformed line fails the job
    (FAILFAST), is kept with NULL fields and its text in ``_corrupt_record``
    (PERMISSIVE), or is left out (DROPMALFORMED).  With ``episode_from_line``
    the episode is the recording named in the line.  The end is the sum of two
    doubles; if ``exact``, that of the numbers as they are written, so that turns
    that end together do so to the last bit.
    """
    if mode not in (FAILFAST, PERMISSIVE, DROPMALFORMED):
        raise ValueError(f"unknown mode {mode!r}")

    def field(i):
        return F.try_element_at("fields", F.lit(i))

    parsed = (
        lines.withColumn("line", strip(F.col("value")))
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))
        .withColumn("fields", words(F.col("line")))
        .withColumns({
            "start": parse_float(field(START_FIELD)), "span": parse_float(field(DURATION_FIELD)),
            "sum": sum_of_texts(field(START_FIELD), field(DURATION_FIELD)) if exact
                   else F.lit(None).cast("double"),
            "head": F.upper(field(1)), "recording": field(RECORDING_FIELD),
            "speaker": field(SPEAKER_FIELD), "n_fields": F.size("fields")})
        .drop("fields"))
    parsed = computed_once(parsed)
    good = F.coalesce(
        (F.col("n_fields") >= FIELDS_NEEDED) & (F.col("head") == "SPEAKER")
        & F.col("start").isNotNull() & F.col("span").isNotNull(), F.lit(False))
    if mode == DROPMALFORMED:
        parsed = parsed.where(good)
    elif mode == FAILFAST:
        complaint = F.concat(
            F.lit("malformed speaker turn: "), F.col("n_fields").cast("string"),
            F.lit(f" fields ({FIELDS_NEEDED} needed), first "), F.coalesce("head", F.lit("none")),
            F.lit(", in "), F.col("line"))
        parsed = parsed.where(
            F.when(good, F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean")))
    episode = F.col("recording") if episode_from_line else F.col("episode_id")
    columns = [
        episode.alias("episode_id"), "line_no",
        F.when(good, F.col("start")).alias("start"),
        F.when(good, F.coalesce("sum", F.col("start") + F.col("span"))).alias("end"),
        F.when(good, F.col("speaker")).alias("speaker"),
    ]
    if mode == PERMISSIVE:
        columns.append(F.when(~good, F.col("value")).alias("_corrupt_record"))
    return parsed.select(*columns)


def read_rttm(spark, path, mode=FAILFAST, episodes="line", exact=False):
    """Speaker turns of a file, folder or pattern.

    ``episodes`` says where the episode id is: the ``file`` name, the
    ``directory`` (``episode_id=``), or the recording field of each ``line``.
    """
    if episodes not in ("file", "directory", "line"):
        raise ValueError(f"unknown place of the episode id {episodes!r}")
    return parse_rttm(
        ordered_lines(spark, path, episodes == "directory"), mode, episodes == "line", exact)


def rttm_line(start, end, speaker, recording=None):
    """One turn as text; times have three decimals."""
    gap = F.lit("<NA>")
    return F.concat_ws(
        " ", F.lit("SPEAKER"), gap if recording is None else recording, F.lit("1"),
        fixed(start, 3), fixed(end - start, 3), gap, gap, speaker, gap, gap)


def write_rttm(turns, path, mode="errorifexists", order=("start", "end", "speaker"),
               per_episode=False):
    """Write turns (episode_id, start, end, speaker) ordered by time (or ``order``),
    computed once.

    Lines name their episode as the recording; with ``per_episode`` they do not,
    and each episode has a directory.
    """
    one_word = F.when(~F.col("episode_id").rlike(SPACE_RUN), F.col("episode_id"))
    recording = None if per_episode else required(one_word, F.concat(
        F.lit("an episode id with spaces cannot be a recording: "), F.col("episode_id")))
    lines = turns.select(
        "episode_id", *order,
        rttm_line(F.col("start"), F.col("end"), F.col("speaker"), recording).alias("line"))
    with settled_while(lines, "lines") as rows:
        write_lines(rows, path, order, mode, per_episode)
