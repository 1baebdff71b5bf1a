"""The jobs: transcribe, diarize, assign speakers, infer names, and all in a row.

Each runs over all episodes of its input tables at once.  Model calls are
settled (written once) before their answers are used.  A job that is given a
``folder`` keeps the tables of its steps there: run again with the same inputs and
models (by name), it takes over finished steps, and of prompts it asks only those
without an answer.  ``drop_folder`` removes them.

What a job skips it counts: give it ``Steps(spark)`` or ``Steps(spark, folder)`` as
``folder`` and read ``counts``, a dictionary by step, when it is done.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyframe.functions.prompts import ANSWER_FORMAT, SECOND_ROUND, context_summary
from parleyframe.operators import models, naming
from parleyframe.operators.audio import audio_duration, blocks_between, chunk_audio, clip_pcm
from parleyframe.operators.chunks import (
    _grid, chunk_windows, dedup_turns, reference_chunks, windows_without_turns,
    with_speaker_label)
from parleyframe.operators.evidence import speaker_profiles
from parleyframe.operators.overlap import (
    assign_speakers, episodes_without_turns, require_turns)
from parleyframe.operators.prompting import answered, build_prompts, refine_targets
from parleyframe.operators.roster import candidate_roster, people_from_entities
from parleyframe.operators.voices import (
    assign_centroid, centroids, cluster_speakers, count_speakers, target_speakers)
from parleyframe.schemas import Settings
from parleyframe.sources.rttm import (
    DROPMALFORMED, FAILFAST, PERMISSIVE, read_rttm, write_rttm)
from parleyframe.sources.segments import (
    NAMED_FIELDS, SEGMENT_FIELDS, read_transcript, read_utterances, write_segments)
from parleyframe.sources.tables import Steps, load_reference, save_reference

DEFAULTS = Settings()
_CORRUPT = "_corrupt_record"
WINDOW_MINUTES, WINDOW_OVERLAP = 30, 30


# ------------------------------------------------------------------ transcribe

def transcribe(pcm, model, block_samples, settings=DEFAULTS, window_minutes=WINDOW_MINUTES,
               overlap_seconds=WINDOW_OVERLAP):
    """PCM to transcript.  Every recording is transcribed in overlapping windows,
    so that no task holds more than one; a segment comes from the window whose
    core holds its midpoint, whole on either side of an edge."""
    if settings.clip_audio:
        pcm = clip_pcm(pcm, settings.clip_start_sec, settings.clip_duration_sec,
                       block_samples, settings.sample_rate)
    audio = chunk_audio(pcm, block_samples, window_minutes, overlap_seconds)
    length_ms, step_ms = _grid(window_minutes, overlap_seconds)
    return models.transcribe_windows(
        audio, model, step_ms, settings.tick_factor, length_ms - step_ms)


def _settled_transcript(steps, pcm, model, *arguments):
    return steps("transcript", lambda: transcribe(pcm, model, *arguments), pcm,
                 model=model.name, arguments=arguments)


def transcribe_files(spark, pcm_path, output_path, model, block_samples, settings=DEFAULTS,
                     window_minutes=WINDOW_MINUTES, layout="records", folder=None,
                     overlap_seconds=WINDOW_OVERLAP):
    """The same from a stored PCM table to segment JSON; the model hears every window
    once, whatever the layout."""
    transcript = _settled_transcript(
        Steps.of(spark, folder), spark.read.parquet(pcm_path), model, block_samples, settings,
        window_minutes, overlap_seconds)
    write_segments(transcript, output_path, SEGMENT_FIELDS, layout)


# ------------------------------------------------------------------ diarize

def diarize(pcm, detector, embedder, block_samples, settings=DEFAULTS, reference_path=None,
            lengths=None, strict=False, folder=None):
    """PCM to speaker turns (episode_id, line_no, start, end, speaker).

    Voices are clustered in the first window of each episode; every window's
    turns then go to the nearest voice.  ``line_no`` is the pair (start, end),
    the order turns are written in.  With ``reference_path`` the labelled
    reference turns are stored there and read back.  ``lengths`` (episode_id,
    duration_ms) are found from the PCM table if not given, from ``n_samples``
    where it has that column; audio beyond them fails the job.  ``strict`` stops
    when a window has no turns at all; otherwise an episode whose first window
    has none keeps its later turns, as UNKNOWN.  Tables are settled in ``folder``.
    """
    spark = pcm.sparkSession
    steps = Steps.of(spark, folder)
    grid = (settings.chunk_minutes, settings.overlap_seconds)
    if lengths is None:
        lengths = audio_duration(pcm).select(
            "episode_id", F.ceil(F.col("seconds") * 1000).cast("long").alias("duration_ms"))
    windows = steps("windows", lambda: chunk_windows(lengths, *grid), lengths, grid=grid)
    audio = chunk_audio(pcm, block_samples, *grid)
    wanted = F.lit(settings.num_speakers).cast("int")

    def turns_of(some_audio, some_windows, name):
        return steps(
            name, lambda: models.detect_turns(
                some_audio, some_windows, detector, embedder, settings.min_embedding_seconds),
            pcm, some_windows, detector=detector.name, embedder=embedder and embedder.name,
            settings=settings, block_samples=block_samples)

    if settings.num_speakers:
        turns = turns_of(audio, windows.withColumn("num_speakers", wanted), "turns")
        reference = turns.where(F.col("chunk_idx") == 0)
        targets = target_speakers(count_speakers(reference), settings.num_speakers)
    else:
        # The number found in the first window is what the detector is then asked
        # for; it is left to itself where there was none.
        opening = blocks_between(
            pcm, 0, settings.chunk_minutes * 60, block_samples, settings.sample_rate)
        reference = turns_of(
            chunk_audio(opening, block_samples, *grid).where(F.col("idx") == 0),
            reference_chunks(windows).withColumn("num_speakers", wanted), "reference")
        targets = steps(
            "targets", lambda: target_speakers(count_speakers(reference)), reference)
        turns = turns_of(
            audio, windows.join(
                targets.select("episode_id", "num_speakers"), "episode_id", "left"), "turns")
    if strict and not windows_without_turns(windows, turns).isEmpty():
        raise ValueError("some windows have no turns")
    labelled = steps("labelled", lambda: cluster_speakers(
        reference.select("episode_id", "turn_pos", "embedding"), targets), reference, targets)
    if reference_path:
        # A run that goes on writes what it wrote before.
        save_reference(labelled, reference_path, "overwrite" if steps.named else "errorifexists")
        labelled = load_reference(spark, reference_path)
    middles = steps("centroids", lambda: centroids(labelled), labelled)
    named = assign_centroid(turns, middles)
    placed = named.withColumns({
        "start": F.col("start") + F.col("global_start"),
        "end": F.col("end") + F.col("global_start")})
    return with_speaker_label(dedup_turns(placed)).select(
        "episode_id", F.struct("start", "end").alias("line_no"), "start", "end", "speaker")


def diarize_files(spark, pcm_path, output_path, detector, embedder, block_samples,
                  settings=DEFAULTS, reference_path=None, strict=True, per_episode=False,
                  folder=None):
    """The same from a stored PCM table to RTTM."""
    turns = diarize(
        spark.read.parquet(pcm_path), detector, embedder, block_samples, settings,
        reference_path, strict=strict, folder=folder)
    write_rttm(turns, output_path, per_episode=per_episode)


# ------------------------------------------------------------------ assign speakers

def assign(transcript, turns, settings=DEFAULTS, strict=False, folder=None):
    """Transcript and turns to utterances.  ``strict`` fails on an episode of the
    transcript that has no turns at all; otherwise its rows are UNKNOWN and the
    episode is counted.  Both inputs are used more than once and settled first, so
    each is parsed once.  Turns that were read with their malformed lines
    (``_corrupt_record``) are counted and go on without these."""
    steps, read, heard = Steps.of(transcript.sparkSession, folder), transcript, turns
    transcript = steps("segments", lambda: read, read, counted={"segments": F.count("*")})
    counted = {"turns": F.count("*")}
    if _CORRUPT in heard.columns:
        counted = {"turns": F.count_if(F.col(_CORRUPT).isNull()),
                   "malformed_lines": F.count(_CORRUPT)}
    turns = steps("speaker-turns", lambda: heard, heard, counted=counted)
    if _CORRUPT in turns.columns:
        turns = turns.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    if strict:
        transcript = require_turns(transcript, turns)
    else:
        said = transcript
        steps("episodes-without-turns", lambda: episodes_without_turns(
            said.select("episode_id").distinct(), turns), said, turns,
            counted={"episodes_without_turns": F.count("*")})
    return assign_speakers(transcript, turns, settings.unknown_label)


def assign_files(spark, transcript_path, rttm_path, output_path, settings=DEFAULTS,
                 layout="records", rttm_mode=FAILFAST, rttm_episodes="line", strict=True,
                 partitioned=False, folder=None):
    """The same from transcript JSON and RTTM files to segment JSON.

    A turn ends at the sum of start and duration as they are written; a sum of doubles
    would let its last bit decide between turns that overlap a segment equally long."""
    transcript = read_transcript(
        spark, transcript_path, settings.transcript_time_factor, layout, partitioned)
    # Lines to be left out are read, so that they can be counted.
    turns = read_rttm(
        spark, rttm_path, PERMISSIVE if rttm_mode == DROPMALFORMED else rttm_mode, rttm_episodes,
        exact=True)
    result = assign(transcript, turns, settings, strict, folder)
    write_segments(result, output_path, layout=layout)
    return result


# ------------------------------------------------------------------ infer names

def contexts(episodes, extractor=None, hosts=(), settings=DEFAULTS):
    """(episode_id, candidate_names, context) from episode metadata."""
    about = episodes.withColumn(
        "_about", F.concat(F.col("name"), F.lit("\n"), F.col("description")))
    if extractor is not None:
        about = models.with_entities(about, "_about", extractor)
        people = people_from_entities(F.col("entities"))
    else:
        people = F.array().cast("array<string>")
    return about.select(
        "episode_id",
        candidate_roster(F.col("name"), people, hosts).alias("candidate_names"),
        context_summary(F.col("name"), F.col("description"), settings.description_words)
        .alias("context"))


def inference_cycle(profiles, episode_contexts, model, number, targets=None, strict=False,
                    concurrency=None, instructions=ANSWER_FORMAT, folder=None):
    """One round of asking: prompts for the target speakers (default: all, by
    first appearance), answers, and their proposals of pass ``number``, settled.  In a
    named folder the answers are kept one by one (``models.generate_into``)."""
    steps = Steps.of(profiles.sparkSession, folder)
    order = ("first_start", "first_pos")
    if targets is not None:
        profiles = refine_targets(profiles, targets, strict)
        order = ("target_pass", "target_pos")
    prompts = build_prompts(profiles, episode_contexts, order, instructions)

    def proposals():
        if steps.named:
            answers = models.generate_into(prompts, model, f"{steps.folder}/answers", concurrency)
        else:
            answers = models.generate(prompts, model, concurrency)
        return models.read_proposals(answers.withColumn("pass", F.lit(number)), strict)

    return models.without_faults(steps(
        f"proposals-{number}", proposals, prompts, counted=models.fault_counts(),
        model=model.name, strict=strict))


@dataclass
class NamedSpeakers:
    """``assignments`` per speaker, the ``labelled`` utterances, and by step the
    ``counts`` of what was used and what was skipped."""

    assignments: DataFrame
    labelled: DataFrame
    counts: dict = field(default_factory=dict)


def infer_names(utterances, episodes, model, extractor=None, hosts=(), settings=DEFAULTS,
                strict=False, concurrency=None, instructions=ANSWER_FORMAT,
                retry_note=SECOND_ROUND, folder=None):
    """Utterances to named utterances.

    All speakers are asked about once.  Those whose proposal is not confident,
    or clashes with another, are asked about once more; of both answers the more
    confident counts, unchecked.  What stays below the threshold is UNKNOWN.
    ``instructions`` open every prompt and ``retry_note`` ends the context of the
    second round's.
    """
    steps = Steps.of(utterances.sparkSession, folder)
    profiles = steps("profiles", lambda: speaker_profiles(
        utterances, settings.quotes_start, settings.quotes_end), utterances, settings=settings)
    # An episode without metadata is asked about with an empty title and description.
    known = (
        profiles.select("episode_id").distinct().join(episodes, "episode_id", "left")
        .fillna("", ["name", "description"]))
    about = steps("contexts", lambda: contexts(known, extractor, hosts, settings),
                  profiles, episodes, extractor=extractor and extractor.name,
                  hosts=tuple(hosts), settings=settings)

    def cycle(number, some_contexts, targets=None):
        return inference_cycle(
            profiles, some_contexts, model, number, targets, strict, concurrency, instructions,
            steps)

    proposals = cycle(1, about)
    merged, rounds = naming.consolidate(proposals), [proposals]
    if settings.max_passes > 1:
        open_cases = naming.unresolved_speakers(
            merged, naming.conflict_flags(proposals, settings.high_confidence),
            settings.high_confidence)
        targets = open_cases.select(
            "episode_id", "speaker_id", F.col("first_pass").alias("target_pass"),
            F.col("first_pos").alias("target_pos"))
        focused = about.withColumn("context", F.concat(F.col("context"), F.lit(retry_note)))
        rounds.append(cycle(2, focused, targets))
        merged = naming.consolidate(proposals.unionByName(rounds[1]))
    steps("answered", lambda: answered(profiles, proposals), profiles, proposals, counted={
        "invented_speakers": F.count_if(~F.col("asked")),
        "speakers_left_out": F.count_if(~F.col("proposed"))})
    final = steps("names", lambda: naming.finalize_assignments(
        merged, settings.high_confidence), *rounds, settings=settings)
    return NamedSpeakers(
        final, naming.label_transcript(utterances, final, settings.start_offset_sec),
        steps.counts)


def infer_files(spark, transcript_path, output_path, episodes, model, extractor=None, hosts=(),
                settings=DEFAULTS, layout="records", strict=False, partitioned=False,
                folder=None, **asking):
    """The same from diarized JSON to JSON with names; returns the assignments."""
    steps = Steps.of(spark, folder)
    read = read_utterances(spark, transcript_path, layout, partitioned)
    utterances = steps("utterances", lambda: read, read)
    result = infer_names(
        utterances, episodes, model, extractor, hosts, settings, strict, folder=steps, **asking)
    write_segments(result.labelled, output_path, NAMED_FIELDS, layout)
    return result.assignments


# ------------------------------------------------------------------ everything

def process_corpus(pcm, episodes, speech, detector, embedder, namer, block_samples,
                   extractor=None, hosts=(), settings=DEFAULTS, window_minutes=WINDOW_MINUTES,
                   overlap_seconds=WINDOW_OVERLAP, strict=False, folder=None, **asking):
    """PCM and episode metadata to named utterances."""
    steps = Steps.of(pcm.sparkSession, folder)
    transcript = _settled_transcript(
        steps, pcm, speech, block_samples, settings, window_minutes, overlap_seconds)
    turns = diarize(
        pcm, detector, embedder, block_samples, settings, strict=strict, folder=steps)
    said = assign(transcript, turns, settings, strict, steps)
    utterances = steps("utterances", lambda: said, said)
    return infer_names(
        utterances, episodes, namer, extractor, hosts, settings, strict, folder=steps, **asking)
