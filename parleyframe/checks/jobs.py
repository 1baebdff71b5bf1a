"""Whole jobs with stand-in models."""

from pyspark.sql import functions as F

from parleyframe.checks.inputs import BLOCK, MONO, RATE, STEREO
from parleyframe.checks.registry import check
from parleyframe.checks.scans import fresh_folder
from parleyframe.checks.speakers import flags_sql, merged_sql
from parleyframe.checks.stand_ins import (
    DETECTOR, NAMER, PEOPLE, QUIET, RETRY_NOTE, SPEECH, VOICE)
from parleyframe.checks.timeline import ASSIGNED
from parleyframe.operators import evidence
from parleyframe.plans import jobs
from parleyframe.schemas import Settings
from parleyframe.sources.rttm import write_rttm
from parleyframe.sources.segments import (
    SEGMENT_FIELDS, read_transcript, read_utterances, write_segments)
from parleyframe.sources.tables import settle

# ------------------------------------------------------------------ transcribe

MIXED = f"""(
SELECT episode_id, block * {BLOCK} + i AS nth, avg(x) AS x FROM (
  SELECT episode_id, block, unnest(generate_series(0, len(samples) - 1)) AS i,
         unnest(CAST(samples AS DOUBLE[])) AS x FROM {STEREO} s) a
GROUP BY episode_id, block * {BLOCK} + i)"""


# Whatever the windows, the answer is that for the whole recording.
@check(f"""
SELECT seconds, episode_id, CAST(sec AS DOUBLE) AS start, sec + 1e0 AS "end", CAST(n AS STRING) AS text
FROM (SELECT episode_id, nth // {RATE} AS sec, count(*) FILTER (WHERE CAST(x AS FLOAT) > 0) AS n
      FROM {MIXED} m GROUP BY episode_id, nth // {RATE}) t, (VALUES (30), (14)) w(seconds)""")
def job_transcribe(inputs):
    def by(seconds):
        return jobs.transcribe(inputs.stereo, SPEECH, BLOCK, window_minutes=seconds / 60,
                               overlap_seconds=4).withColumn("seconds", F.lit(seconds)).drop("pos")
    return by(30).unionByName(by(14))


# Written and read again, in every layout of the files.
@check(f"""
SELECT layout, episode_id, CAST(sec AS DOUBLE) AS start, sec + 1e0 AS "end", CAST(n AS STRING) AS text
FROM (SELECT episode_id, nth // {RATE} AS sec, count(*) FILTER (WHERE CAST(x AS FLOAT) > 0) AS n
      FROM {MIXED} m GROUP BY episode_id, nth // {RATE}) t,
     (VALUES ('records'), ('lines'), ('array')) w(layout)""")
def job_transcribe_files(inputs):
    spark = inputs.spark
    audio, written = fresh_folder(spark, "audio"), []
    inputs.stereo.write.parquet(audio)
    for layout in ("records", "lines", "array"):
        path = fresh_folder(spark, layout)
        jobs.transcribe_files(spark, audio, path, SPEECH, BLOCK, layout=layout)
        written.append(read_transcript(
            spark, path, layout=layout, partitioned=layout != "records").select(
            F.lit(layout).alias("layout"), "episode_id", "start", "end", "text"))
    return written[0].unionByName(written[1]).unionByName(written[2])


@check(f"""
SELECT episode_id, CAST(sec AS BIGINT) AS pos, CAST(sec AS DOUBLE) AS start, sec + 1e0 AS "end",
       CAST(n AS STRING) AS text
FROM (SELECT episode_id, (nth - {3 * RATE}) // {RATE} AS sec,
             count(*) FILTER (WHERE CAST(x AS FLOAT) > 0) AS n
      FROM {MIXED} m WHERE nth >= {3 * RATE} AND nth < {13 * RATE}
      GROUP BY episode_id, (nth - {3 * RATE}) // {RATE}) t""")
def job_transcribe_clip(inputs):
    settings = Settings(clip_audio=True, clip_start_sec=3, clip_duration_sec=10, sample_rate=RATE)
    return jobs.transcribe(inputs.stereo, SPEECH, BLOCK, settings)


# ------------------------------------------------------------------ diarize

DIARIZE = Settings(chunk_minutes=40 / 60, overlap_seconds=8)


# A voice is the loudest sample of four seconds, modulo 3; voices are numbered by
# their first turn in the first window, and one that is new later sounds like
# the first (all are equally far away).
VOICES = f"""(
SELECT episode_id, block, (list_position(samples, list_max(samples)) - 1) % 3 AS voice FROM {{mono}} m)"""


def diarized(mono):
    heard = VOICES.format(mono=mono)
    return f"""(
SELECT h.episode_id, block * 4e0 AS t_start, block * 4e0 + 4 AS t_end,
       printf('SPEAKER_%02d', CAST(coalesce(n, 0) AS INT)) AS speaker
FROM {heard} h LEFT JOIN (
  SELECT episode_id, voice, row_number() OVER (PARTITION BY episode_id ORDER BY min(block)) - 1 AS n
  FROM {heard} f WHERE block < 10 GROUP BY episode_id, voice) k
ON h.episode_id = k.episode_id AND h.voice = k.voice)"""


@check(f"""SELECT episode_id, t_start AS start, t_end AS "end", speaker FROM {diarized(MONO)} d""")
def job_diarize(inputs):
    path = fresh_folder(inputs.spark, "voices")
    return jobs.diarize(inputs.mono, DETECTOR, VOICE, BLOCK, DIARIZE, path).drop("line_no")


# Channels count from 1 and the first window is silent: turns stay, unnamed.
@check(f"""
SELECT episode_id, (block + 10) * 4e0 AS start, (block + 10) * 4e0 + 4 AS "end",
       'UNKNOWN' AS speaker FROM {MONO} m""")
def job_diarize_late(inputs):
    block = F.explode(F.when(F.col("block") > 0, F.array("block")).otherwise(
        F.sequence(F.lit(-10).cast("long"), F.lit(0).cast("long"))))
    late = inputs.mono.withColumn("b", block).select(
        "episode_id", F.lit(1).alias("channel"), (F.col("b") + 10).alias("block"), "sample_rate",
        F.when(F.col("b") < 0, F.transform("samples", lambda x: F.lit(0.0).cast("float")))
        .otherwise(F.col("samples")).alias("samples"))
    return jobs.diarize(late, QUIET, VOICE, BLOCK, DIARIZE).drop("line_no")


# ------------------------------------------------------------------ assign

# Times go through three-decimal text, which centiseconds survive; the end is
# the sum of start and duration again.
@check(f"""
SELECT episode_id, pos, t_start AS start, t_end AS "end", speaker, text FROM {ASSIGNED} a""")
def job_assign(inputs):
    spark = inputs.spark
    segments, turns, output = (
        fresh_folder(spark, name) for name in ("segments", "turns", "diarized"))
    write_segments(inputs.transcript, segments, SEGMENT_FIELDS)
    write_rttm(inputs.voiced, turns, order=["line_no"])
    jobs.assign_files(spark, segments, turns, output)
    return read_utterances(spark, output)


# ------------------------------------------------------------------ infer names

def evidence_sql(assigned):
    return f"""(
SELECT episode_id, speaker AS speaker_id, count(*) AS n,
       CASE WHEN regexp_matches(right(speaker, 1), '[0-9]') THEN CAST(right(speaker, 1) AS INT)
            ELSE 9 END AS s,
       row_number() OVER (PARTITION BY episode_id ORDER BY min((t_start, pos))) AS spot
FROM {assigned} a GROUP BY episode_id, speaker)"""


def replies(evidence_sql, retry):
    """What the stand-in namer proposes about the speakers shown to it."""
    return f"""(
SELECT episode_id, CAST({retry + 1} AS INT) AS pass, spot AS pos, speaker_id,
       list_extract(['Ann', 'ann', 'Bob', 'unknown', 'Eve', 'UNKNOWN'],
                    CAST((n * 3 + s * 2 + {retry}) % 6 + 1 AS BIGINT)) AS proposed_name,
       (n * 7 + s * 3 + {retry * 5}) % 11 / 10.0e0 AS confidence,
       concat(CAST(n AS STRING), ' turns, round {retry + 1}') AS justification
FROM {evidence_sql} e WHERE (n + s) % 7 <> 0
UNION ALL
SELECT DISTINCT episode_id, CAST({retry + 1} AS INT), 1000000, 'SPEAKER_99', 'Zed', 0.5e0, ''
FROM {evidence_sql} f)"""


def infer_sql(assigned):
    return f"""
WITH evidence AS {evidence_sql(assigned)},
round1 AS {replies('evidence', 0)},
flags AS {flags_sql('round1')},
merged1 AS {merged_sql('round1')},
targets AS (
  SELECT e.* FROM evidence e JOIN merged1 m
    ON e.episode_id = m.episode_id AND e.speaker_id = m.speaker_id
  LEFT JOIN flags f ON m.episode_id = f.episode_id AND m.speaker_id = f.speaker_id
  WHERE confidence < 0.8 OR NOT coalesce(consistent, true)),
both_rounds AS (SELECT * FROM round1 UNION ALL SELECT * FROM {replies('targets', 1)} r),
names AS (
  SELECT episode_id, speaker_id, CASE WHEN confidence >= 0.8 THEN proposed_name ELSE 'UNKNOWN' END
           AS proposed_name, confidence, justification
  FROM {merged_sql('both_rounds')} m)"""


INFER = infer_sql(ASSIGNED)

LABELLED = """
SELECT a.episode_id, {pos} t_start AS start, t_end AS "end", speaker, text,
       coalesce(proposed_name, 'UNKNOWN') AS speaker_name, coalesce(confidence, 0e0) AS confidence,
       coalesce(justification, '') AS justification
FROM {assigned} a LEFT JOIN names n ON a.episode_id = n.episode_id AND a.speaker = n.speaker_id"""


@check(INFER + LABELLED.format(pos="pos,", assigned=ASSIGNED))
def job_infer_names(inputs):
    utterances = settle(jobs.assign(inputs.transcript, inputs.voiced), "utterances")
    return jobs.infer_names(
        utterances, inputs.episodes, NAMER, PEOPLE, ["Zoë"], retry_note=RETRY_NOTE).labelled


@check(f"""{INFER} SELECT * FROM names""")
def job_infer_assignments(inputs):
    utterances = settle(jobs.assign(inputs.transcript, inputs.voiced), "utterances")
    return jobs.infer_names(
        utterances, inputs.episodes, NAMER, retry_note=RETRY_NOTE).assignments.drop(
        "first_pass", "first_pos")


@check(f"""{INFER}
SELECT episode_id, speaker_id, proposed_name, confidence, justification FROM round1""")
def inference_cycle(inputs):
    utterances = settle(jobs.assign(inputs.transcript, inputs.voiced), "utterances")
    return jobs.inference_cycle(
        evidence.speaker_profiles(utterances), jobs.contexts(inputs.episodes), NAMER, 1
    ).drop("pass", "pos")


# Each second of speech belongs to the voice of its four seconds.
SECONDS = f"""(
SELECT m.episode_id, sec AS pos, CAST(sec AS DOUBLE) AS t_start, sec + 1e0 AS t_end,
       CAST(n AS STRING) AS text, speaker
FROM (SELECT episode_id, block * 4 + i // {RATE} AS sec, count(*) FILTER (WHERE x > 0) AS n
      FROM (SELECT episode_id, block, unnest(generate_series(0, len(samples) - 1)) AS i,
                   unnest(samples) AS x FROM {MONO} u) v GROUP BY episode_id, block * 4 + i // {RATE}) m
JOIN {diarized(MONO)} d ON m.episode_id = d.episode_id AND sec >= d.t_start AND sec < d.t_end)"""


@check(infer_sql(SECONDS) + LABELLED.format(pos="", assigned=SECONDS))
def job_corpus(inputs):
    return jobs.process_corpus(
        inputs.mono, inputs.episodes, SPEECH, DETECTOR, VOICE, NAMER, BLOCK, settings=DIARIZE,
        window_minutes=0.5, overlap_seconds=4, retry_note=RETRY_NOTE).labelled.drop("pos")
