"""Overlap joins, windows and interval arithmetic."""

from pyspark.sql import functions as F

from parleyframe.checks.inputs import (
    BLOCK, EMBEDDED, EPISODES, RATE, SPACES_SQL, SPOKEN, STEREO, VOICED)
from parleyframe.checks.registry import check
from parleyframe.functions.intervals import duration, pad_to
from parleyframe.operators import chunks, models
from parleyframe.operators.audio import clip_pcm, mixdown_pcm
from parleyframe.operators.overlap import assign_speakers as assign
from parleyframe.operators.overlap import episodes_without_turns as without_turns
from parleyframe.operators.overlap import overlap_join as join

PAIRS = f"""(
SELECT s.episode_id, s.pos, v.line_no, v.speaker,
       least(t_end, d_end) - greatest(t_start, d_start) AS overlap
FROM {SPOKEN} s JOIN {VOICED} v ON s.episode_id = v.episode_id
WHERE least(t_end, d_end) > greatest(t_start, d_start))"""

ASSIGNED = f"""(
SELECT s.episode_id, s.pos, t_start, t_end, coalesce(w.speaker, 'UNKNOWN') AS speaker, text
FROM {SPOKEN} s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY episode_id, pos ORDER BY overlap DESC, line_no) AS rn
  FROM {PAIRS} p) w
ON s.episode_id = w.episode_id AND s.pos = w.pos AND w.rn = 1)"""


@check(f"""
SELECT episode_id, pos, line_no, speaker, round(overlap, 4) AS overlap FROM {PAIRS} p""")
def overlap_join(inputs):
    return join(inputs.transcript, inputs.voiced).withColumn("overlap", F.round("overlap", 4))


# Every seventh turn lasts minutes to days or for ever, as does every eleventh segment.
def _long(table, number, start, end):
    return f"""(
SELECT * REPLACE (CASE WHEN {number} % 7 = 3 THEN CASE {number} % 3 WHEN 0 THEN {start} + 900
    WHEN 1 THEN {start} + 86400 ELSE CAST('inf' AS DOUBLE) END ELSE {end} END AS {end}) FROM {table} t)"""


@check(f"""
SELECT s.episode_id, s.pos, v.line_no,
       CASE WHEN isinf(least(t_end, d_end)) THEN -1
            ELSE round(least(t_end, d_end) - greatest(t_start, d_start), 4) END AS overlap
FROM {_long(SPOKEN, 'pos', 't_start', 't_end')} s
JOIN {_long(VOICED, 'line_no', 'd_start', 'd_end')} v ON s.episode_id = v.episode_id
WHERE least(t_end, d_end) > greatest(t_start, d_start)""")
def overlap_join_long(inputs):
    def lengthened(table, number):
        number = F.col(number)
        end = F.when(number % 3 == 0, F.col("start") + 900).when(
            number % 3 == 1, F.col("start") + 86400).otherwise(F.lit(float("inf")))
        return table.withColumn("end", F.when(number % 7 == 3, end).otherwise(F.col("end")))
    found = join(lengthened(inputs.transcript, "pos"), lengthened(inputs.voiced, "line_no"))
    size = F.when(F.col("overlap") == float("inf"), -1.0).otherwise(F.round("overlap", 4))
    return found.select("episode_id", "pos", "line_no", size.alias("overlap"))


@check(f"""
SELECT episode_id, pos, t_start AS start, t_end AS "end", speaker, text FROM {ASSIGNED} a""")
def assign_speakers(inputs):
    return assign(inputs.transcript, inputs.voiced)


@check(f"""
SELECT episode_id FROM {EPISODES} e WHERE NOT EXISTS (
  SELECT 1 FROM {VOICED} v WHERE v.episode_id = e.episode_id)""")
def episodes_without_turns(inputs):
    return without_turns(inputs.episodes.select("episode_id"), inputs.voiced)


@check(f"""
SELECT episode_id, pos, t0 / 100.0e0 AS start, t1 / 100.0e0 AS "end",
       trim(text, {SPACES_SQL}) AS text FROM {SPOKEN} s""")
def normalize_timestamps(inputs):
    raw = inputs.spoken.withColumn("text", F.concat(F.lit(" "), "text", F.lit("\n")))
    return models.normalize_segments(raw).select("episode_id", "pos", "start", "end", "text")


@check(f"""
SELECT episode_id, line_no, greatest(0e0, d_end - d_start) AS duration FROM {VOICED} v""")
def utterance_duration(inputs):
    return inputs.voiced.select(
        "episode_id", "line_no", duration(F.col("start"), F.col("end")).alias("duration"))


@check("""
SELECT event_id, CASE WHEN b - a >= 2 THEN a WHEN hi - lo >= 2 THEN lo WHEN lo = 0 THEN lo
         WHEN hi = len THEN greatest(0e0, len - 2) ELSE greatest(0e0, lo - gap) END AS start,
       CASE WHEN b - a >= 2 THEN b WHEN hi - lo >= 2 THEN hi WHEN lo = 0 THEN least(len, 2e0)
         WHEN hi = len THEN hi ELSE least(len, hi + gap) END AS "end"
FROM (
  SELECT *, (2e0 - (hi - lo)) / 2e0 AS gap FROM (
    SELECT *, greatest(0e0, 0.5e0 * (a + b) - 1e0) AS lo,
           least(len, 0.5e0 * (a + b) + 1e0) AS hi FROM (
      SELECT event_id, a, a + event_id % 50 / 20.0e0 AS b,
             a + event_id % 50 / 20.0e0 + event_id % 30 / 10.0e0 AS len
      FROM (SELECT event_id, event_id * 37 % 90 / 10.0e0 AS a FROM {events}) x) y) z) t""")
def pad_segments(inputs):
    n = F.col("event_id")
    start = n * 37 % 90 / 10.0
    end = start + n % 50 / 20.0
    padded = pad_to(start, end, 2.0, end + n % 30 / 10.0)
    return inputs.table("events").select("event_id", padded.alias("p")).select("event_id", "p.*")


WINDOWS = f"""(
SELECT episode_id, CAST(idx AS INT) AS idx, idx * 570000 AS start_ms,
       least(idx * 570000 + 600000, duration_ms) AS end_ms, duration_ms
FROM (SELECT episode_id, duration_ms,
             unnest(generate_series(0, (duration_ms - 1) // 570000)) AS idx
      FROM {EPISODES} e WHERE duration_ms > 0) w)"""


@check(f"""
SELECT episode_id, idx, start_ms, end_ms, start_ms / 1000.0e0 AS global_start,
       end_ms / 1000.0e0 AS global_end FROM {WINDOWS} w""")
def chunk_windows(inputs):
    return chunks.chunk_windows(inputs.episodes)


@check(f"""
SELECT episode_id, idx, start_ms, end_ms FROM {WINDOWS} w WHERE idx = 0""")
def reference_windows(inputs):
    return chunks.reference_chunks(chunks.chunk_windows(inputs.episodes)).select(
        "episode_id", "idx", "start_ms", "end_ms")


@check(f"""
SELECT episode_id, turn_pos, label FROM {EMBEDDED} e WHERE chunk_idx = 0""")
def reference_turns(inputs):
    turns = inputs.embedded.withColumnRenamed("chunk_idx", "idx")
    return chunks.reference_chunks(turns).select("episode_id", "turn_pos", "label")


# Content: for every document, its passages of a thousand characters' time.
@check(f"""
SELECT c.episode_id, piece, w.idx FROM (
  SELECT episode_id, unnest(generate_series(0, (duration_ms - 1) // 500000)) AS piece, duration_ms
  FROM {EPISODES} e WHERE duration_ms > 0) c
JOIN {WINDOWS} w ON c.episode_id = w.episode_id
 AND piece * 500000 < w.end_ms AND least(piece * 500000 + 500000, c.duration_ms) > w.start_ms""")
def chunk_membership(inputs):
    content = (
        inputs.episodes.where("duration_ms > 0")
        .withColumn("piece", F.explode(F.expr("sequence(0L, (duration_ms - 1) div 500000)")))
        .withColumn("start_ms", F.col("piece") * 500000)
        .withColumn("end_ms", F.least(F.col("start_ms") + 500000, "duration_ms")))
    return chunks.chunk_membership(content).select("episode_id", "piece", "idx")


@check(f"""
SELECT episode_id, turn_pos, t_start + chunk_idx * 570e0 AS start,
       t_end + chunk_idx * 570e0 AS "end" FROM {EMBEDDED} e""")
def globalize_turns(inputs):
    windows = chunks.chunk_windows(
        inputs.embedded.groupBy("episode_id").agg(
            ((F.max("chunk_idx") + 1).cast("long") * 570000).alias("duration_ms")))
    return chunks.globalize_turns(inputs.embedded, windows).select(
        "episode_id", "turn_pos", "start", "end")


@check(f"""
SELECT episode_id, "start", "end", label, printf('SPEAKER_%02d', label) AS speaker FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id, "start", "end"
                               ORDER BY chunk_idx DESC, turn_pos DESC) AS rn
  FROM (SELECT *, floor(t_start / 30) AS "start", floor(t_start / 30) + turn_pos % 3 AS "end"
        FROM {EMBEDDED} e) x WHERE "end" > "start") y WHERE rn = 1""")
def dedup_turns(inputs):
    coarse = inputs.embedded.withColumn("start", F.floor(F.col("start") / 30).cast("double"))
    coarse = coarse.withColumn("end", F.col("start") + F.col("turn_pos") % 3)
    return chunks.with_speaker_label(chunks.dedup_turns(coarse))


@check(f"""
SELECT episode_id, channel, nth - {3 * RATE} AS nth, CAST(sample AS DOUBLE) AS sample FROM (
  SELECT episode_id, channel, block * {BLOCK} + unnest(generate_series(0, len(samples) - 1)) AS nth,
         unnest(samples) AS sample FROM {STEREO} s) x
WHERE nth >= {3 * RATE} AND nth < {13 * RATE}""", name="clip_pcm")
def clip_samples(inputs):
    clip = clip_pcm(inputs.stereo, 3, 10, BLOCK, RATE)
    return clip.select(
        "episode_id", "channel", "first_sample", F.posexplode("samples").alias("i", "sample")
    ).select("episode_id", "channel", (F.col("first_sample") + F.col("i")).alias("nth"),
             F.col("sample").cast("double").alias("sample"))


@check(f"""
SELECT episode_id, block, CAST(i AS INT) AS i, 
       CAST(CAST(avg(CAST(sample AS DOUBLE)) AS FLOAT) AS DOUBLE) AS sample
FROM (SELECT episode_id, block, unnest(generate_series(0, len(samples) - 1)) AS i,
             unnest(samples) AS sample FROM {STEREO} s) x
GROUP BY episode_id, block, i""", name="mixdown_pcm")
def mixdown_samples(inputs):
    mixed = mixdown_pcm(inputs.stereo)
    return mixed.select("episode_id", "block", F.posexplode("samples").alias("i", "sample")).select(
        "episode_id", "block", "i", F.col("sample").cast("double").alias("sample"))
