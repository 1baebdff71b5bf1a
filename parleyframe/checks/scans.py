"""Readers, writers and scalar functions."""


from pyspark.sql import functions as F

from parleyframe.checks.inputs import BLOCK, EMBEDDED, MONO, RATE, SPACE_PATTERN, SPACES_SQL, SPOKEN, STEREO, VOICED
from parleyframe.checks.registry import check
from parleyframe.functions import numbers, text
from parleyframe.functions.vectors import cosine_distance
from parleyframe.operators.audio import audio_duration, chunk_audio
from parleyframe.operators.chunks import chunk_file
from parleyframe.sources.rttm import parse_rttm, rttm_line
from parleyframe.sources.segments import (
    DIARIZED_FIELDS, SEGMENT_FIELDS, as_transcript, as_utterances, parse_arrays, parse_objects,
    read_transcript, segment_json, write_segments)
from parleyframe.sources.tables import load_reference, run_folder, save_reference


def fresh_folder(spark, name):
    return f"{run_folder(spark)}/{name}"


# Each document is one transcript file: a JSON array with a segment per line of
# text, some times written as numbers and some in quotes.
@check("""
SELECT episode_id, CAST(i AS BIGINT) AS pos, i * 2.5e0 / 2 AS start, (i + 1) * 2.5e0 / 2 AS "end", text
FROM (SELECT CAST(doc_id AS STRING) AS episode_id,
             unnest(string_split(text, chr(10))) AS text,
             unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i
      FROM {documents}) a""")
def scan_transcript(inputs):
    documents = inputs.table("documents").select(
        F.col("doc_id").cast("string").alias("episode_id"),
        F.to_json(F.transform(
            F.split("text", "\n"),
            lambda line, i: F.struct(
                (i * F.lit(2.5)).alias("start"),
                ((i + 1) * F.lit(2.5)).cast("string").alias("end"),
                line.alias("text")))).alias("value"))
    return as_transcript(parse_arrays(documents, SEGMENT_FIELDS), time_factor=2.0)


@check(f"""
SELECT episode_id, pos, t_start AS start, t_end AS "end", role AS speaker,
       trim(text, {SPACES_SQL}) AS text FROM {SPOKEN} s""")
def scan_utterances(inputs):
    lines = inputs.spoken.select(
        "episode_id", F.col("pos").alias("line_no"),
        F.to_json(F.struct(
            "start", F.col("end").cast("string").alias("end"), F.col("role").alias("speaker"),
            F.concat(F.lit(" \t"), "text", F.lit("　\x1c\n")).alias("text"))).alias("value"))
    return as_utterances(parse_objects(lines, DIARIZED_FIELDS))


@check(f"""
SELECT episode_id, line_no * 3 + 2 AS line_no, d_start AS start,
       d_start + (d_end - d_start) AS "end", speaker FROM {VOICED} v""")
def scan_rttm(inputs):
    spoken = inputs.voiced.withColumn("span", F.col("end") - F.col("start"))
    turn = F.concat_ws(
        " ", F.lit("  speaker"), "episode_id", F.lit("1"), F.col("start").cast("string"),
        F.concat(F.col("span").cast("string"), F.lit("\t")), F.lit("<NA>"), F.lit("<NA>"),
        "speaker", F.lit("<NA>"))
    lines = spoken.select(
        "episode_id", "line_no",
        F.posexplode(F.array(F.lit("# turns"), F.lit(" \t"), turn)).alias("k", "value"))
    return parse_rttm(lines.select(
        "episode_id", (F.col("line_no") * 3 + F.col("k")).alias("line_no"), "value"))


@check(f"""
SELECT episode_id, line_no,
       printf('SPEAKER <NA> 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', d_start, d_end - d_start, speaker)
         AS line FROM {VOICED} v""")
def rttm_lines(inputs):
    return inputs.voiced.select(
        "episode_id", "line_no",
        rttm_line(F.col("start"), F.col("end"), F.col("speaker")).alias("line"))


@check(f"""
SELECT episode_id, pos, t_start AS start, t_end AS "end",
       CASE WHEN role <> 'system' THEN role END AS speaker, text, true AS names_speaker
FROM {SPOKEN} s""")
def segments_json(inputs):
    speaker = F.when(F.col("role") != "system", F.col("role")).alias("speaker")
    written = inputs.spoken.withColumn("speaker", speaker).select(
        "episode_id", "pos", segment_json(DIARIZED_FIELDS).alias("line"))
    item = F.from_json("line", "start double, end double, speaker string, text string")
    return written.select(
        "episode_id", "pos", item.alias("item"),
        F.col("line").contains('"speaker":').alias("names_speaker")
    ).select("episode_id", "pos", "item.*", "names_speaker")


@check(f"""
SELECT episode_id, turn_pos, label, list_sum(CAST(embedding AS DOUBLE[]))::DECIMAL(18, 4)::DOUBLE
         AS total, len(embedding)::INT AS size
FROM {EMBEDDED} e WHERE chunk_idx = 0""")
def cluster_state_roundtrip(inputs):
    path = fresh_folder(inputs.spark, "reference")
    save_reference(inputs.embedded.where("chunk_idx = 0"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return load_reference(inputs.spark, path).select(
        "episode_id", "turn_pos", "label",
        total.cast("decimal(18,4)").cast("double").alias("total"),
        F.size("embedding").alias("size"))


@check(f"""
SELECT episode_id, CAST(max(n) AS BIGINT) AS num_frames, 16 AS sample_rate,
       max(n) / 16.0e0 AS seconds
FROM (SELECT episode_id, channel, sum(len(samples)) AS n FROM {STEREO} s
      WHERE channel = 1 OR block < 40 GROUP BY episode_id, channel) c
GROUP BY episode_id""", name="audio_duration")
def duration_per_episode(inputs):
    # Channels count from 1, and one is shorter.
    uneven = inputs.stereo.where("channel = 1 OR block < 40")
    return audio_duration(uneven.withColumn("channel", F.col("channel") + 1))


# Arrays of many episodes, each over several part files, are read back as lines.
@check(f"""
SELECT episode_id, pos, t_start AS start, t_end AS "end", text FROM {SPOKEN} s""")
def array_roundtrip(inputs):
    path = fresh_folder(inputs.spark, "arrays")
    spark, kept = inputs.spark, inputs.spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        write_segments(inputs.transcript, path, SEGMENT_FIELDS, "array")
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", kept)
    read = read_transcript(spark, path, layout="array", partitioned=True)
    # Lines count from the opening bracket; turns are not always numbered without gaps.
    ranks = inputs.transcript.select("episode_id", "start", "end", "text", F.col("pos"))
    return read.drop("pos").join(ranks, ["episode_id", "start", "end", "text"]).select(
        "episode_id", "pos", "start", "end", "text")


CHUNK_MINUTES, OVERLAP_SECONDS = 0.5, 4.5
STEP, LENGTH = 25500, 30000


@check(f"""
WITH s AS (
  SELECT episode_id, block * {BLOCK} + i AS nth, sample FROM (
    SELECT episode_id, block, unnest(samples) AS sample,
           unnest(generate_series(0, len(samples) - 1)) AS i FROM {MONO} m) x),
w AS (
  SELECT episode_id, idx, idx * {STEP} * {RATE} // 1000 AS low,
         (idx * {STEP} + {LENGTH}) * {RATE} // 1000 AS high
  FROM (SELECT episode_id, unnest(generate_series(0, max(nth) * 1000 // {RATE} // {STEP})) AS idx
        FROM s GROUP BY episode_id) y)
SELECT s.episode_id, CAST(idx AS INT) AS idx, printf('chunk_%03d.wav', idx) AS file,
       count(*) AS n_samples, CAST(sum(CAST(sample AS DOUBLE) * (nth - low)) AS DECIMAL(18, 3))::DOUBLE
         AS weighted
FROM s JOIN w ON s.episode_id = w.episode_id AND nth >= low AND nth < high
GROUP BY s.episode_id, idx""")
def chunk_manifest(inputs):
    pieces = chunk_audio(inputs.mono, BLOCK, CHUNK_MINUTES, OVERLAP_SECONDS)
    weighted = F.aggregate(
        F.transform("samples", lambda x, i: x.cast("double") * (F.col("first_sample") + i)),
        F.lit(0.0), lambda s, x: s + x)
    return pieces.groupBy("episode_id", "idx").agg(
        F.sum(F.size("samples")).alias("n_samples"),
        F.sum(weighted).cast("decimal(18,3)").cast("double").alias("weighted"),
    ).withColumn("file", chunk_file(F.col("idx")))


@check(f"""
SELECT episode_id, pos, printf('[%.2fs -> %.2fs]: %s', t_start, t_end, text) AS line
FROM {SPOKEN} s""")
def transcript_report(inputs):
    return inputs.spoken.select(
        "episode_id", "pos",
        text.timed_line(F.col("start"), F.col("end"), F.col("text")).alias("line"))


_PADDED = "concat(chr(9), chr(12288), text, chr(160), chr(10))"


@check(f"""
SELECT doc_id, trim({_PADDED}, {SPACES_SQL}) AS stripped,
       CASE WHEN trim(text, {SPACES_SQL}) = '' THEN 0
            ELSE len(regexp_split_to_array(trim(text, {SPACES_SQL}), '{SPACE_PATTERN}')) END::INT
         AS n_words,
       array_to_string(regexp_split_to_array(trim(text, {SPACES_SQL}), '{SPACE_PATTERN}'), ', ')
         AS joined,
       upper(lang) AS up, lower(source) AS low, split_part(text, ' - ', 1) AS title
FROM {{documents}}""")
def text_functions(inputs):
    t = F.col("text")
    padded = F.concat(F.lit("\t　"), t, F.lit("\xa0\n"))
    return inputs.table("documents").select(
        "doc_id", text.strip(padded).alias("stripped"), F.size(text.words(t)).alias("n_words"),
        F.array_join(text.words(t), ", ").alias("joined"), F.upper("lang").alias("up"),
        F.lower("source").alias("low"), text.show_title(t).alias("title"))


@check("""
SELECT event_id, printf('%.1f', value) AS one, printf('%.2f', value) AS two,
       printf('%.3f', value / 8) AS three, value AS parsed,
       CAST(event_id % 1000 AS DOUBLE) * 1000 AS spelled, event_id % 10 >= 8 AS high,
       greatest(value, 100e0) AS more, least(value, 100e0) AS less
FROM {events}""")
def number_functions(inputs):
    x = F.col("value")
    share = (F.col("event_id") % 10).cast("double") / 10
    shaky = F.when(F.col("event_id") % 10 == 7, float("nan")).otherwise(share)
    spelled = F.concat(F.lit(" "), (F.col("event_id") % 1000).cast("string"), F.lit("_0.0e2\n"))
    return inputs.table("events").select(
        "event_id", text.fixed(x, 1).alias("one"), text.fixed(x, 2).alias("two"),
        text.fixed(x / 8, 3).alias("three"),
        numbers.parse_float(x.cast("string")).alias("parsed"),
        numbers.parse_float(spelled).alias("spelled"), numbers.at_least(shaky, 0.8).alias("high"),
        F.greatest(x, F.lit(100.0)).alias("more"), F.least(x, F.lit(100.0)).alias("less"))


@check("""
SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]),
                                          CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS distance
FROM {embeddings}""")
def cosine_distances(inputs):
    v = F.col("embedding").cast("array<double>")
    return inputs.table("embeddings").select(
        "vec_id", F.round(cosine_distance(v, F.reverse(v)), 6).alias("distance"))
