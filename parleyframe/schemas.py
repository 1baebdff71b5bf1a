"""Table schemas and default settings shared by all operators.

Every table is keyed by ``episode_id``.  Rows carry an explicit order column
(``pos``, ``line_no``, ``turn_pos``) wherever a result depends on order.
"""

from dataclasses import dataclass

from pyspark.sql import types as T

UNKNOWN = "UNKNOWN"


def _table(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _D, _F = T.StringType(), T.DoubleType(), T.FloatType()
_I, _L = T.IntegerType(), T.LongType()

TRANSCRIPT = _table(
    ("episode_id", _S), ("pos", _L), ("start", _D), ("end", _D), ("text", _S))
DIARIZATION = _table(
    ("episode_id", _S), ("line_no", _L), ("start", _D), ("end", _D), ("speaker", _S))
UTTERANCES = _table(
    ("episode_id", _S), ("pos", _L), ("start", _D), ("end", _D),
    ("speaker", _S), ("text", _S))
EPISODES = _table(
    ("episode_id", _S), ("name", _S), ("description", _S), ("duration_ms", _L))
TURNS = _table(
    ("episode_id", _S), ("chunk_idx", _I), ("turn_pos", _L), ("start", _D),
    ("end", _D), ("embedding", T.ArrayType(_F)))
ASSIGNMENTS = _table(
    ("episode_id", _S), ("pass", _I), ("pos", _L), ("speaker_id", _S),
    ("proposed_name", _S), ("confidence", _D), ("justification", _S))
PCM = _table(
    ("episode_id", _S), ("channel", _I), ("block", _L), ("sample_rate", _I),
    ("n_samples", _I), ("samples", T.ArrayType(_F)))


@dataclass(frozen=True)
class Settings:
    """Defaults of the jobs; each operator takes the same values as arguments."""

    clip_start_sec: int = 0
    clip_duration_sec: int = 100
    clip_audio: bool = False
    sample_rate: int = 16000
    tick_factor: float = 100.0          # speech-model times are centiseconds
    transcript_time_factor: float = 1.0
    unknown_label: str = UNKNOWN
    chunk_minutes: float = 10
    overlap_seconds: float = 30
    num_speakers: int | None = None
    min_embedding_seconds: float = 2.0
    quotes_start: int = 50
    quotes_end: int = 50
    max_passes: int = 3                 # more than one allows a single retry
    high_confidence: float = 0.8
    start_offset_sec: float = 0.0
    description_words: int = 3000
