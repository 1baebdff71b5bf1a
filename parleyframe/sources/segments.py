"""Transcript segments as JSON.

Layouts:

``records``  one JSON object per line that names its episode_id and pos; any
             number of episodes per file.  Splittable, read in one pass.
``lines``    one JSON object per line, one episode per file or directory.
``array``    one JSON array per episode.  ``write_segments`` writes it with a segment
             per line into ``episode_id=`` folders, which are read back as lines,
             split and in any number of part files (``partitioned``).  An array
             from elsewhere is one file named after its episode; one with line
             ends is read in splits too (``arrays.py``).
"""

from pyspark.sql import functions as F

from parleyframe.functions.numbers import parse_float, required
from parleyframe.functions.text import strip
from parleyframe.sources.arrays import array_elements
from parleyframe.sources.lines import (
    computed_once, numbered_lines, settled_while, write_lines)

SEGMENT_FIELDS = ("start", "end", "text")
DIARIZED_FIELDS = ("start", "end", "speaker", "text")
NAMED_FIELDS = (*DIARIZED_FIELDS, "speaker_name", "confidence", "justification")


def _json_struct(fields):
    # Times are read as text: a number in quotes is valid and must not become NULL.
    return "struct<" + ",".join(f"`{name}`:string" for name in fields) + ">"


def parse_arrays(documents, fields):
    """(episode_id, value = JSON array) to one row per element, with ``pos``."""
    items = F.from_json(
        F.col("value"), f"array<{_json_struct(fields)}>", {"mode": "FAILFAST"})
    checked = F.when(strip(F.col("value")).startswith("["), items).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("episode_id"))))
    return (
        documents.select("episode_id", F.posexplode(checked).alias("pos", "item"))
        .select("episode_id", F.col("pos").cast("long").alias("pos"), "item.*"))


def parse_objects(lines, fields):
    """(episode_id, line_no, value = JSON object) to one row per non-blank line."""
    item = F.from_json(F.col("value"), _json_struct(fields), {"mode": "FAILFAST"})
    return (
        lines.where(strip(F.col("value")) != "")
        .select("episode_id", F.col("line_no").alias("pos"), item.alias("item"))
        .select("episode_id", "pos", "item.*"))


def _seconds(name, factor):
    value = parse_float(F.col(name))
    message = F.concat(
        F.lit(f"segment without a usable {name}: "), F.col("episode_id"), F.lit(" at "),
        F.col("pos").cast("string"))
    return (required(value, message) / float(factor)).alias(name)


def _text(name):
    message = F.concat(
        F.lit(f"segment without {name}: "), F.col("episode_id"), F.lit(" at "),
        F.col("pos").cast("string"))
    return required(F.col(name), message)


def as_transcript(records, time_factor=1.0):
    """Typed transcript rows; times are divided by ``time_factor``."""
    return computed_once(records.select(
        "episode_id", "pos", _seconds("start", time_factor), _seconds("end", time_factor),
        _text("text").alias("text")))


def as_utterances(records):
    """Typed diarized rows with stripped text.

    Reading order is (start, pos): a stable sort by start.  It stays a pair of
    columns, because numbering the rows would bring a whole recording into one
    task; use ``in_spoken_order`` to sort a table by it.
    """
    return computed_once(records.select(
        "episode_id", "pos", _seconds("start", 1.0), _seconds("end", 1.0),
        _text("speaker").alias("speaker"), strip(_text("text")).alias("text")))


def in_spoken_order(table):
    return table.orderBy("episode_id", "start", "pos")


def _records(spark, path, fields, layout, partitioned):
    if layout == "records":
        kinds = ", ".join(f"`{name}` string" for name in fields)
        return (
            spark.read.schema(f"episode_id string, pos bigint, {kinds}")
            .option("mode", "FAILFAST").json(path))
    if layout == "lines":
        return parse_objects(numbered_lines(spark, path, partitioned), fields)
    if layout == "array" and partitioned:
        lines = numbered_lines(spark, path, True).where(~F.col("value").isin("[", "]"))
        return parse_objects(
            lines.withColumn("value", F.regexp_replace("value", "^,", "")), fields)
    if layout == "array":
        return array_elements(spark, path, _json_struct(fields)).select(
            "episode_id", "pos", "item.*")
    raise ValueError(f"unknown layout {layout!r}")


def read_transcript(spark, path, time_factor=1.0, layout="records", partitioned=False):
    return as_transcript(
        _records(spark, path, SEGMENT_FIELDS, layout, partitioned), time_factor)


def read_utterances(spark, path, layout="records", partitioned=False):
    return as_utterances(_records(spark, path, DIARIZED_FIELDS, layout, partitioned))


def segment_json(fields):
    """One segment as a JSON object; NULLs are written, not left out."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_segments(segments, path, fields=DIARIZED_FIELDS, layout="records",
                   mode="errorifexists"):
    """Write segments in (episode, ``pos``) order.

    ``records`` share files; ``lines`` and ``array`` have a directory per
    episode.  The part files of an ``array``, read one after the other, are one
    JSON array (an episode of ordinary length is a single file): the brackets
    are lines of their own and commas lead, so the array is never assembled in
    memory.  ``segments`` are computed once.
    """
    if layout not in ("records", "lines", "array"):
        raise ValueError(f"unknown layout {layout!r}")
    keys = ("episode_id", "pos") if layout == "records" else ()
    with settled_while(segments.select(
            "episode_id", "pos", segment_json((*keys, *fields)).alias("line")), "lines") as rows:
        if layout == "array":
            write_lines(_bracketed(rows), path, ["pos", "part"], mode, per_episode=True)
        else:
            write_lines(rows, path, ["pos"], mode, per_episode=layout == "lines")


def _bracketed(rows):
    """The lines of each episode as those of one JSON array."""
    ends = rows.groupBy("episode_id").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    body = rows.join(ends, "episode_id").select(
        "episode_id", "pos", F.lit(1).alias("part"),
        F.concat(F.when(F.col("pos") == F.col("first_pos"), "").otherwise(","),
                 F.col("line")).alias("line"))
    opening = ends.select("episode_id", F.col("first_pos").alias("pos"), F.lit(0), F.lit("["))
    closing = ends.select("episode_id", F.col("last_pos").alias("pos"), F.lit(2), F.lit("]"))
    return body.union(opening).union(closing)
