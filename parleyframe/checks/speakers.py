"""Evidence, prompts, rosters, proposals and names."""

from pyspark.sql import functions as F

from parleyframe.checks.inputs import EPISODES, PROPOSED, SPACE_PATTERN, SPACES_SQL, SPOKEN
from parleyframe.checks.registry import check
from parleyframe.checks.stand_ins import PEOPLE
from parleyframe.functions import text
from parleyframe.functions.prompts import ANSWER_FORMAT
from parleyframe.operators import evidence, models, naming, prompting, roster
from parleyframe.operators.voices import count_speakers as count
from parleyframe.plans.jobs import contexts

# ------------------------------------------------------------------ evidence

STATS = f"""(
SELECT episode_id, role AS speaker_id, sum(greatest(0, t1 - t0)) / 100.0e0 AS total_duration,
       count(*) AS total_turns, min(t_start) AS first_start, max(t_end) AS last_end,
       arg_min(pos, (t_start, pos)) AS first_pos
FROM {SPOKEN} s GROUP BY episode_id, role)"""


def quotes_sql(n, m):
    """Head and tail rows per speaker (part, start, pos, text) of the spoken table;
    no ``m``: all rows."""
    tail = f"WHERE rn <= {m}" if m else ""
    return f"""(
SELECT episode_id, role AS speaker, 0 AS part, t_start, pos, text FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id, role ORDER BY t_start, pos) AS rn
  FROM {SPOKEN} s) a WHERE rn <= {n}
UNION ALL
SELECT episode_id, role, 1, t_start, pos, text FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id, role ORDER BY t_start DESC, pos DESC) AS rn
  FROM {SPOKEN} s) b {tail})"""


def quotes_joined(n, m, before="", after="", between=" | "):
    return f"""(
SELECT episode_id, speaker, string_agg('{before}' || text || '{after}', '{between}'
                                       ORDER BY part, t_start, pos) AS quotes
FROM {quotes_sql(n, m)} q GROUP BY episode_id, speaker)"""


@check(f"""
SELECT episode_id, speaker_id, round(total_duration, 3) AS total_duration, total_turns,
       first_start, last_end, quotes, first_pos
FROM {STATS} p JOIN {quotes_joined(2, 1)} q
USING (episode_id) WHERE q.speaker = p.speaker_id""")
def speaker_profiles(inputs):
    return evidence.speaker_profiles(inputs.utterances, 2, 1).select(
        "episode_id", "speaker_id", F.round("total_duration", 3).alias("total_duration"),
        "total_turns", "first_start", "last_end",
        F.array_join("sample_quotes", " | ").alias("quotes"), "first_pos")


@check(f"""
SELECT episode_id, speaker, part, t_start AS start, pos, text FROM {quotes_sql(2, 2)} q""")
def sample_quotes(inputs):
    return evidence.quote_rows(inputs.utterances, 2, 2)


# The last sample of size 0 is the whole list.
@check(f"""
SELECT episode_id, speaker, part, t_start AS start, pos, text
FROM {quotes_sql(1, None)} q""")
def sample_quotes_all(inputs):
    return evidence.quote_rows(inputs.utterances, 1, 0)


# Samples of size 0 as arrays: no first texts, and every text as the last.
@check(f"""
SELECT episode_id, speaker, string_agg(text, ' | ' ORDER BY part, t_start, pos) AS quotes
FROM {quotes_sql(0, None)} q GROUP BY episode_id, speaker""")
def sample_quotes_array(inputs):
    return evidence.sample_quotes(inputs.utterances, 0, 0).select(
        "episode_id", "speaker", F.array_join("sample_quotes", " | ").alias("quotes"))


@check(f"""
SELECT episode_id, count(DISTINCT role) AS n_speakers, CAST(count(DISTINCT role) AS INT)
         AS num_speakers FROM {SPOKEN} s GROUP BY episode_id""")
def count_speakers(inputs):
    from parleyframe.operators.voices import target_speakers
    return target_speakers(count(inputs.utterances, "speaker"), 0)


# ------------------------------------------------------------------ prompts

def block_sql(quotes):
    return f"""concat('Speaker: ', speaker_id, chr(10), 'total_duration_sec: ',
  printf('%.1f', total_duration), chr(10), 'turn_count: ', CAST(total_turns AS STRING), chr(10),
  'first_start_sec: ', printf('%.1f', first_start), chr(10), 'last_end_sec: ',
  printf('%.1f', last_end), chr(10), 'Quotes:', chr(10), {quotes}, chr(10))"""


NEWLINE_QUOTES = f"""(
SELECT episode_id, speaker, string_agg('- "' || text || '"', chr(10)
                                       ORDER BY part, t_start, pos) AS quotes
FROM {quotes_sql(2, 1)} q GROUP BY episode_id, speaker)"""

BLOCKS = f"""(
SELECT p.episode_id, speaker_id, first_start, first_pos, {block_sql('quotes')} AS block
FROM {STATS} p JOIN {NEWLINE_QUOTES} q ON p.episode_id = q.episode_id AND speaker = speaker_id)"""


@check(f"SELECT episode_id, speaker_id, block FROM {BLOCKS} b")
def prompt_blocks(inputs):
    profiles = evidence.speaker_profiles(inputs.utterances, 2, 1)
    return prompting.prompt_blocks(profiles).select("episode_id", "speaker_id", "block")


ROSTER = """array_to_string(list_sort(list_distinct(list_concat(
  [{people}, 'Unknown Host', 'Unknown Guest', 'Zoë', ' spaced'],
  CASE WHEN split_part(name, ' - ', 1) = '' THEN [] ELSE [split_part(name, ' - ', 1)] END))), '{by}')"""


@check(f"""
SELECT episode_id, {ROSTER.format(people="'Al', 'Zoë'", by='|')} AS names FROM {EPISODES} e""")
def candidate_roster(inputs):
    names = roster.candidate_roster(
        F.col("name"), F.array(F.lit("Al"), F.lit("Zoë")), hosts=["Zoë", " spaced"])
    return inputs.episodes.select("episode_id", F.array_join(names, "|").alias("names"))


@check(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(
         string_split(text, ' '),
         lambda w: substr(w, 1, 1) <> lower(substr(w, 1, 1)) AND length(w) % 2 = 1),
         lambda w: trim(w, {SPACES_SQL})))), '|') AS people
FROM {{documents}}""")
def candidate_people(inputs):
    found = models.with_entities(inputs.table("documents"), "text", PEOPLE)
    return found.select("doc_id", F.array_join(
        roster.people_from_entities(F.col("entities")), "|").alias("people"))


def words_sql(c):
    return f"regexp_split_to_array(trim({c}, {SPACES_SQL}), '{SPACE_PATTERN}')"


def limited_sql(c, n):
    return f"""CASE WHEN len({words_sql(c)}) <= {n} THEN {c}
  ELSE array_to_string(list_slice({words_sql(c)}, 1, {n}), ' ') END"""


@check(f"SELECT doc_id, {limited_sql('text', 120)} AS text FROM {{documents}}")
def truncate_text(inputs):
    return inputs.table("documents").select(
        "doc_id", text.limit_words(F.col("text"), 120).alias("text"))


CONTEXT = f"""(
SELECT episode_id, {ROSTER.format(people="'Al'", by=', ')} AS names,
  concat('Title: ', name, chr(10), 'Description: ',
         {limited_sql(f"trim(description, {SPACES_SQL})", 3000)}) AS context
FROM {EPISODES} e)"""


@check(f"""
SELECT b.episode_id,
       '{ANSWER_FORMAT}' || chr(10) || 'Episode Context:' || chr(10)
       || coalesce(any_value(context), '') || chr(10) || chr(10) || 'Candidate Names: '
       || coalesce(any_value(names), 'Unknown') || chr(10) || chr(10)
       || 'Speaker Evidence:' || chr(10)
       || string_agg(block, chr(10) || chr(10) ORDER BY first_start, first_pos) || chr(10) AS prompt
FROM {BLOCKS} b LEFT JOIN {CONTEXT} c ON b.episode_id = c.episode_id GROUP BY b.episode_id""")
def build_prompts(inputs):
    profiles = evidence.speaker_profiles(inputs.utterances, 2, 1)
    about = contexts(inputs.episodes, hosts=["Al", "Zoë", " spaced"])
    return prompting.build_prompts(profiles, about)


TARGETS = f"""(
SELECT episode_id, speaker AS speaker_id, target_pos FROM (
  SELECT episode_id, CASE role WHEN 'system' THEN 'nobody' ELSE role END AS speaker,
         max(pos) AS target_pos FROM {SPOKEN} s GROUP BY episode_id, 2) t)"""


@check(f"""
SELECT p.episode_id, p.speaker_id, total_turns, target_pos FROM {STATS} p
JOIN {TARGETS} t ON p.episode_id = t.episode_id AND p.speaker_id = t.speaker_id""")
def refine_targets(inputs):
    profiles = evidence.speaker_stats(inputs.utterances).withColumnRenamed("speaker", "speaker_id")
    invented = F.when(F.col("role") == "system", "nobody").otherwise(F.col("role"))
    targets = inputs.spoken.groupBy("episode_id", invented.alias("speaker_id")).agg(
        F.max("pos").alias("target_pos"))
    return prompting.refine_targets(profiles, targets).select(
        "episode_id", "speaker_id", "total_turns", "target_pos")


# ------------------------------------------------------------------ proposals

def flags_sql(proposals):
    """Consistency verdicts of the proposals (episode_id, pos, speaker_id, ...)."""
    return f"""(
WITH o AS (
  SELECT *, upper(proposed_name) = 'UNKNOWN' AS unk,
         first_value(speaker_id) OVER (PARTITION BY episode_id, pass, lower(proposed_name) ORDER BY pos)
           AS owner
  FROM {proposals} p),
ev AS (
  SELECT episode_id, pass, speaker_id, pos, CASE WHEN unk THEN confidence <= 0.8
         WHEN owner <> speaker_id THEN false END AS v FROM o
  UNION ALL
  SELECT episode_id, pass, owner, pos, false FROM o WHERE NOT unk AND owner <> speaker_id),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, pass, speaker_id
             ORDER BY CASE WHEN v IS NULL THEN 1 ELSE 0 END, pos DESC) AS rn FROM ev)
SELECT episode_id, pass, speaker_id, coalesce(v, true) AS consistent FROM r WHERE rn = 1)"""


def merged_sql(proposals):
    """The most confident proposal per speaker."""
    return f"""(
SELECT episode_id, speaker_id, proposed_name, confidence, justification FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id, speaker_id
                               ORDER BY confidence DESC, pass, pos) AS rn
  FROM {proposals} p) x WHERE rn = 1)"""


FIRST_PASS = f"(SELECT * FROM {PROPOSED} f WHERE pass = 1)"


@check(f"SELECT * FROM {flags_sql(PROPOSED)} f")
def critic_flags(inputs):
    return naming.conflict_flags(inputs.proposed)


@check(f"SELECT * FROM {merged_sql(PROPOSED)} m")
def consolidate(inputs):
    return naming.consolidate(inputs.proposed).drop("first_pass", "first_pos")


@check(f"""
SELECT episode_id, speaker_id, CASE WHEN confidence >= 0.8 THEN proposed_name ELSE 'UNKNOWN' END
         AS proposed_name, confidence, justification FROM {merged_sql(PROPOSED)} m""")
def finalize_assignments(inputs):
    return naming.finalize_assignments(naming.consolidate(inputs.proposed)).drop(
        "first_pass", "first_pos")


UNRESOLVED = f"""
FROM {merged_sql(FIRST_PASS)} m LEFT JOIN {flags_sql(FIRST_PASS)} f
ON m.episode_id = f.episode_id AND m.speaker_id = f.speaker_id
WHERE NOT (confidence >= 0.8) OR NOT coalesce(consistent, true)"""


@check(f"SELECT m.episode_id, m.speaker_id, proposed_name, confidence {UNRESOLVED}")
def unresolved_speakers(inputs):
    first = inputs.proposed.where("pass = 1")
    return naming.unresolved_speakers(
        naming.consolidate(first), naming.conflict_flags(first)).select(
        "episode_id", "speaker_id", "proposed_name", "confidence")


@check(f"""
SELECT episode_id, speaker_id, CASE WHEN confidence >= 0.8 THEN proposed_name ELSE 'UNKNOWN' END
         AS proposed_name, confidence FROM {merged_sql(PROPOSED)} m""")
def assignment_summary(inputs):
    return naming.assignment_summary(
        naming.finalize_assignments(naming.consolidate(inputs.proposed)))


@check(f"""
SELECT u.episode_id, u.pos, t_start + 1.5e0 AS start, t_end + 1.5e0 AS "end", voice AS speaker, text,
       coalesce(proposed_name, 'UNKNOWN') AS speaker_name, coalesce(confidence, 0e0) AS confidence,
       coalesce(justification, '') AS justification
FROM (SELECT *, CASE role WHEN 'user' THEN 'SPEAKER_01' WHEN 'system' THEN 'nobody'
                          ELSE 'SPEAKER_02' END AS voice FROM {SPOKEN} s) u
LEFT JOIN {merged_sql(PROPOSED)} m ON u.episode_id = m.episode_id AND u.voice = m.speaker_id""")
def label_transcript(inputs):
    voice = F.when(F.col("speaker") == "user", "SPEAKER_01").when(
        F.col("speaker") == "system", "nobody").otherwise("SPEAKER_02")
    return naming.label_transcript(
        inputs.utterances.withColumn("speaker", voice), naming.consolidate(inputs.proposed), 1.5)


# An answer per proposal: an array with one good, one alien and one bare element;
# answers about Eve are fenced, which makes them invalid.
@check(f"""
SELECT concat(episode_id, '/', CAST(line AS STRING)) AS episode_id, pass, CAST(k AS BIGINT) AS pos,
       speaker_id, proposed_name, confidence, justification
FROM (
  SELECT episode_id, pass, pos AS line, 1 AS k, speaker_id, proposed_name, confidence, justification
  FROM {PROPOSED} p WHERE proposed_name <> 'Eve'
  UNION ALL
  SELECT episode_id, pass, pos, 2, 'None', 'UNKNOWN', 0.4e0, '' FROM {PROPOSED} q
  WHERE proposed_name <> 'Eve') x""")
def parse_assignments(inputs):
    return models.parse_proposals(_answers(inputs))


# The same answers, with what is skipped of them and why.
@check(f"""
SELECT concat(episode_id, '/', CAST(pos AS STRING)) AS episode_id, pass, k AS pos,
       CASE k WHEN 1 THEN speaker_id WHEN 2 THEN 'None' WHEN 3 THEN 'S' END AS speaker_id,
       CASE WHEN k IS NULL THEN 'not JSON' WHEN k = 0 THEN 'no speaker'
            WHEN k = 3 THEN 'confidence is not a number' END AS fault
FROM (SELECT *, unnest(CASE WHEN proposed_name = 'Eve' THEN [CAST(NULL AS BIGINT)]
                            ELSE [0::BIGINT, 1, 2, 3] END) AS k FROM {PROPOSED} p) x""")
def read_answers(inputs):
    return models.read_proposals(_answers(inputs)).select(
        "episode_id", "pass", "pos", "speaker_id", "fault")


# Speaker A of every episode is asked about as well, and the last of them is not.
@check(f"""
SELECT episode_id, speaker_id, bool_or(asked) AS asked, bool_or(proposed) AS proposed FROM (
  SELECT episode_id, speaker_id, true AS asked, false AS proposed FROM {PROPOSED} p
  WHERE speaker_id <> 'SPEAKER_02'
  UNION ALL SELECT episode_id, 'A', true, false FROM {PROPOSED} q
  UNION ALL SELECT episode_id, speaker_id, false, true FROM {PROPOSED} r) x
GROUP BY episode_id, speaker_id""")
def answered_speakers(inputs):
    p = inputs.proposed
    asked = p.where("speaker_id <> 'SPEAKER_02'").select("episode_id", "speaker_id").union(
        p.select("episode_id", F.lit("A")))
    return prompting.answered(asked, p)


def _answers(inputs):
    p = inputs.proposed
    good = F.to_json(F.struct("speaker_id", "proposed_name", "confidence", "justification"))
    array = F.concat(
        F.lit(" [1, "), good, F.lit(', {"speaker_id": null, "confidence": "0.4"}, '),
        F.lit('{"speaker_id": "S", "confidence": null}]\n'))
    fenced = F.concat(F.lit("```json"), array, F.lit("```"))
    answer = F.when(F.col("proposed_name") == "Eve", fenced).otherwise(array)
    return p.select(
        F.concat_ws("/", "episode_id", "pos").alias("episode_id"), "pass",
        answer.alias("response"))
