"""Speech tables derived from the sample tables.

Every derivation works row by row, so it needs no shuffle and no task depends
on how many rows a conversation has.  The same SQL text runs in Spark and in
the checking engine; ``{table}`` is filled in by each.
"""

from parleyframe.functions.text import SPACE_CODES

# Conversation turns on a timeline in centiseconds.  Long texts run into the
# next turn, short ones leave a pause.
SPOKEN = """(
SELECT CAST(conv_id AS STRING) AS episode_id, conv_id AS ep_no, turn AS pos, role, text,
       t0, t0 + 2 * length(text) AS t1,
       CAST(t0 AS DOUBLE) / 100 AS t_start, CAST(t0 + 2 * length(text) AS DOUBLE) / 100 AS t_end
FROM (SELECT *, turn * 1500 + (conv_id * 7 + turn * 13) % 300 AS t0 FROM {conversations}) a)"""

# Speaker turns: the true speaker with jittered bounds (every fourth turn is
# inverted, so it matches nothing), and a second voice that ties exactly or
# speaks briefly.
VOICED = f"""(
SELECT episode_id, ep_no, pos, line_no, CAST(st AS DOUBLE) / 100 AS d_start,
       CAST(en AS DOUBLE) / 100 AS d_end, speaker
FROM (
  SELECT episode_id, ep_no, pos, pos * 2 AS line_no, st,
         CASE WHEN (ep_no * 3 + pos) % 4 = 0 THEN st - 10 ELSE en END AS en,
         CASE role WHEN 'system' THEN 'SPEAKER_00' WHEN 'user' THEN 'SPEAKER_01'
                   ELSE 'SPEAKER_02' END AS speaker
  FROM (SELECT *, greatest(0, t0 + (ep_no * 7 + pos * 13) % 61 - 30) AS st,
               t1 + (ep_no * 5 + pos * 11) % 61 - 30 AS en FROM {SPOKEN} s) a
  UNION ALL
  SELECT episode_id, ep_no, pos, pos * 2 + 1 AS line_no, st,
         CASE WHEN (ep_no * 3 + pos) % 4 = 0 THEN st - 5 WHEN pos % 5 = 2 THEN en
              ELSE st + 150 END AS en, 'SPEAKER_03' AS speaker
  FROM (SELECT *, greatest(0, t0 + (ep_no * 7 + pos * 13) % 61 - 30) AS st,
               t1 + (ep_no * 5 + pos * 11) % 61 - 30 AS en FROM {SPOKEN} s) b
) z)"""

# Two rounds of proposed names with clashes, repeats and threshold values.
PROPOSED = f"""(
SELECT episode_id, CAST(p AS INT) AS pass, line_no AS pos, speaker AS speaker_id,
       CASE (ep_no * 2 + line_no * 3 + p) % 6 WHEN 0 THEN 'Ann' WHEN 1 THEN 'ann'
            WHEN 2 THEN 'Bob' WHEN 3 THEN 'unknown' WHEN 4 THEN 'Eve' ELSE 'UNKNOWN' END
         AS proposed_name,
       CAST((ep_no * 7 + line_no * 3 + p * 2) % 11 AS DOUBLE) / 10 AS confidence,
       concat('line ', CAST(line_no AS STRING)) AS justification
FROM (SELECT *, 1 AS p FROM {VOICED} v UNION ALL SELECT *, 2 AS p FROM {VOICED} w) q)"""

EPISODES = """(
SELECT CAST(doc_id AS STRING) AS episode_id, doc_id AS ep_no,
       CASE WHEN doc_id % 9 = 0 THEN ' - untitled'
            ELSE concat('Show ', CAST(doc_id % 50 AS STRING), ' - part ',
                        CAST(doc_id AS STRING)) END AS name,
       text AS description, n_chars * 500 AS duration_ms
FROM {documents})"""

# Embedded turns: every hundred vectors are a recording of four windows; seconds
# within the window.
EMBEDDED = """(
SELECT CAST(CAST(floor(vec_id / 100.0) AS BIGINT) AS STRING) AS episode_id, CAST(vec_id % 4 AS INT) AS chunk_idx,
       vec_id AS turn_pos, CAST((vec_id * 37) % 5700 AS DOUBLE) / 10 AS t_start,
       CAST((vec_id * 37) % 5700 + 3 + vec_id % 40 AS DOUBLE) / 10 AS t_end,
       label, embedding
FROM {embeddings})"""

# Stereo audio at 16 samples per second: each vector is a block of one channel,
# every hundred a recording.
STEREO = """(
SELECT CAST(CAST(floor(vec_id / 100.0) AS BIGINT) AS STRING) AS episode_id,
       CAST(vec_id % 2 AS INT) AS channel, CAST(floor(vec_id % 100 / 2.0) AS BIGINT) AS block,
       16 AS sample_rate, embedding AS samples
FROM {embeddings})"""

# The same as single-channel recordings.
MONO = """(
SELECT CAST(CAST(floor(vec_id / 100.0) AS BIGINT) AS STRING) AS episode_id, 0 AS channel,
       vec_id % 100 AS block, 16 AS sample_rate,
       embedding AS samples
FROM {embeddings})"""

RATE, BLOCK = 16, 64

TABLES = ("conversations", "documents", "embeddings", "events")

# The whitespace characters of the text functions, as a SQL expression.
SPACES_SQL = " || ".join(f"chr({code})" for code in SPACE_CODES)
SPACE_PATTERN = "[" + "".join(f"\\x{{{code:x}}}" for code in SPACE_CODES) + "]+"


def oracle(sql):
    """The text with plain table names, for the checking engine."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


class Inputs:
    """The derived tables of one folder, with the column names operators use."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def table(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text):
        used = {n: self.table(n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(f"SELECT * FROM {text} t", **used)

    @staticmethod
    def _timed(table, start, end):
        return table.withColumnsRenamed({start: "start", end: "end"})

    @property
    def spoken(self):
        return self._timed(self.sql(SPOKEN), "t_start", "t_end")

    @property
    def voiced(self):
        return self._timed(self.sql(VOICED), "d_start", "d_end").select(
            "episode_id", "line_no", "start", "end", "speaker")

    @property
    def transcript(self):
        return self.spoken.select("episode_id", "pos", "start", "end", "text")

    @property
    def utterances(self):
        return self.spoken.withColumnRenamed("role", "speaker").select(
            "episode_id", "pos", "start", "end", "speaker", "text")

    @property
    def proposed(self):
        return self.sql(PROPOSED)

    @property
    def episodes(self):
        return self.sql(EPISODES).select("episode_id", "name", "description", "duration_ms")

    @property
    def embedded(self):
        return self._timed(self.sql(EMBEDDED), "t_start", "t_end")

    @property
    def stereo(self):
        return self.sql(STEREO)

    @property
    def mono(self):
        return self.sql(MONO)
