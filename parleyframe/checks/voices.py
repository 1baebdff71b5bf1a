"""Centroids, clusters and batch models."""

from pyspark.sql import functions as F

from parleyframe.checks.inputs import BLOCK, EMBEDDED, MONO, RATE, SPOKEN, STEREO
from parleyframe.checks.registry import check
from parleyframe.checks.stand_ins import DETECTOR, ECHO, EMBEDDER, SPEECH
from parleyframe.functions.intervals import pad_to
from parleyframe.operators import audio, chunks, models, voices

MEANS = f"""(
SELECT episode_id, label, i, avg(x) AS mean FROM (
  SELECT episode_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x,
         unnest(generate_series(0, len(embedding) - 1)) AS i
  FROM {EMBEDDED} e WHERE chunk_idx = 0) a GROUP BY episode_id, label, i)"""


@check(f"SELECT episode_id, label, CAST(i AS INT) AS i, round(mean, 7) AS mean FROM {MEANS} m")
def centroids(inputs):
    found = voices.centroids(inputs.embedded.where("chunk_idx = 0"))
    return found.select("episode_id", "label", F.posexplode("centroid").alias("i", "mean")).select(
        "episode_id", "label", "i", F.round("mean", 7).alias("mean"))


@check(f"""
SELECT episode_id, chunk_idx, turn_pos, label, round(distance, 6) AS distance FROM (
  SELECT e.episode_id, chunk_idx, turn_pos, c.label,
         list_cosine_distance(CAST(embedding AS DOUBLE[]), centroid) AS distance,
         row_number() OVER (PARTITION BY e.episode_id, turn_pos ORDER BY
           list_cosine_distance(CAST(embedding AS DOUBLE[]), centroid), c.label) AS rn
  FROM {EMBEDDED} e JOIN (
    SELECT episode_id, label, list(mean ORDER BY i) AS centroid FROM {MEANS} m
    GROUP BY episode_id, label) c ON e.episode_id = c.episode_id) x WHERE rn = 1""")
def assign_centroid(inputs):
    turns = inputs.embedded
    middles = voices.centroids(turns.where("chunk_idx = 0"))
    return voices.assign_centroid(turns.drop("label", "start", "end"), middles).select(
        "episode_id", "chunk_idx", "turn_pos", "label", F.round("distance", 6).alias("distance"))


# Vectors point along one axis per label, so the clusters are the labels, numbered
# by first turn.
@check(f"""
SELECT episode_id, turn_pos, CAST(dense_rank() OVER (PARTITION BY episode_id ORDER BY first) - 1
       AS INT) AS label
FROM (SELECT *, min(turn_pos) OVER (PARTITION BY episode_id, label) AS first
      FROM {EMBEDDED} e WHERE chunk_idx = 0) x""")
def cluster_speakers(inputs):
    length = (1 + F.col("turn_pos") % 5).cast("float")
    axes = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(
        i == F.col("label"), length).otherwise(F.lit(0.0).cast("float")))
    reference = inputs.embedded.where("chunk_idx = 0").withColumn("embedding", axes)
    targets = voices.target_speakers(voices.count_speakers(reference, "label"))
    return voices.cluster_speakers(
        reference.select("episode_id", "turn_pos", "embedding"), targets
    ).select("episode_id", "turn_pos", "label")


SECONDS = f"""(
SELECT episode_id, block * {BLOCK // RATE} + i // {RATE} AS sec, count(*) FILTER (WHERE x > 0) AS n
FROM (SELECT episode_id, block, unnest(generate_series(0, len(samples) - 1)) AS i,
             unnest(samples) AS x FROM {MONO} m) a
GROUP BY episode_id, block * {BLOCK // RATE} + i // {RATE})"""


def _windows(inputs, minutes, overlap):
    lengths = audio.audio_duration(inputs.mono).select(
        "episode_id", (F.col("seconds") * 1000).cast("long").alias("duration_ms"))
    return chunks.chunk_windows(lengths, minutes, overlap)


@check(f"""
SELECT episode_id, CAST(sec // 30 * 4294967296 + sec % 30 AS BIGINT) AS pos,
       CAST(sec AS DOUBLE) AS start, CAST(sec + 1 AS DOUBLE) AS "end", CAST(n AS STRING) AS text
FROM {SECONDS} s""")
def batch_transcribe(inputs):
    windows = audio.chunk_audio(inputs.mono, BLOCK, 0.5, 0)
    return models.transcribe_windows(windows, SPEECH, 30_000)


# Windows of 40 s every 32 s; a turn per full four seconds.
TURNS = f"""(
SELECT episode_id, idx, turn_pos, turn_pos * 4 AS t_start, block, samples
FROM (SELECT episode_id, unnest(generate_series(0, (last * 4 + 3) // 32)) AS idx, last
      FROM (SELECT episode_id, max(block) AS last FROM {MONO} m GROUP BY episode_id) x) w
JOIN (SELECT unnest(generate_series(0, 9)) AS turn_pos) k ON w.idx * 8 + turn_pos <= last
JOIN (SELECT episode_id AS ep, block, samples FROM {MONO} n) s
  ON ep = episode_id AND block = w.idx * 8 + turn_pos)"""

_TURN_SQL = f"""
SELECT episode_id, CAST(idx AS INT) AS chunk_idx, CAST(turn_pos AS BIGINT) AS turn_pos,
       CAST(t_start AS DOUBLE) AS start, CAST(t_start + 4 AS DOUBLE) AS "end",
       concat('v', CAST((list_position(samples, list_max(samples)) - 1) % 3 AS STRING)) AS local_label,
       idx * 32e0 AS global_start"""


def _chunked(inputs):
    windows = _windows(inputs, 40 / 60, 8).withColumn("num_speakers", F.lit(3))
    return audio.chunk_audio(inputs.mono, BLOCK, 40 / 60, 8), windows


@check(f"{_TURN_SQL} FROM {TURNS} t")
def batch_turns(inputs):
    return models.detect_turns(*_chunked(inputs), DETECTOR)


@check(f"""
{_TURN_SQL}, round(list_sum(CAST(samples AS DOUBLE[])), 6) AS total,
CAST(len(samples) AS INT) AS size FROM {TURNS} t""")
def batch_turns_embedded(inputs):
    found = models.detect_turns(*_chunked(inputs), DETECTOR, EMBEDDER)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.withColumns(
        {"total": F.round(total, 6), "size": F.size("embedding")}).drop("embedding")


# One-second turns inside their block, padded to two seconds and cropped.
@check(f"""
SELECT episode_id, block, low AS start, low + 2e0 AS "end",
       round(list_sum(list_slice(CAST(samples AS DOUBLE[]), CAST(low * 16 AS INT) + 1,
                                 CAST(low * 16 AS INT) + 32)), 6) AS total
FROM (SELECT *, greatest(0e0, least(2e0, block % 7 / 2e0 - 0.5e0)) AS low FROM {MONO} m) x""")
def batch_embed(inputs):
    start = F.col("block") % 7 / 2.0
    padded = pad_to(start, start + 1.0, 2.0, F.lit(BLOCK / RATE))
    turns = inputs.mono.withColumn("p", padded).select("*", "p.*")
    cropped = turns.withColumn("samples", F.slice(
        "samples", (F.col("start") * RATE).cast("int") + 1,
        ((F.col("end") - F.col("start")) * RATE).cast("int")))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return models.embed_turns(cropped, EMBEDDER).select(
        "episode_id", "block", "start", "end", F.round(total, 6).alias("total"))


@check(f"""
SELECT episode_id, pos, concat(CAST(length(text) AS STRING), ':', reverse(text)) AS response
FROM {SPOKEN} s""")
def batch_generate(inputs):
    prompts = inputs.spoken.select("episode_id", "pos", F.col("text").alias("prompt"))
    return models.generate(prompts, ECHO).drop("prompt")
