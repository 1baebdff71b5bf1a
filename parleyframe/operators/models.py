"""Batch inference: models supplied by the user, run over tables.

A model is a ``Model(name, load)``: ``load()`` returns the callable and runs
once per Python worker and name.  What the callable takes and returns is
stated by each operator.
"""

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from parleyframe.functions.intervals import padded
from parleyframe.functions.numbers import parse_float
from parleyframe.functions.text import strip
from parleyframe.operators.audio import mixed
from parleyframe.schemas import UNKNOWN
from parleyframe.sources.lines import computed_once
from parleyframe.sources.tables import settle

POSITIONS_PER_PART = 2 ** 32
# Prompts asked between two commits to an answer table.
PROMPTS_AT_ONCE = 10_000
# Texts of a batch a Python worker holds as Python objects, with what is found in them.
TEXTS_AT_ONCE = 32

_LOADED: dict[str, Any] = {}


@dataclass(frozen=True)
class Model:
    name: str
    load: Callable[[], Any]

    def get(self):
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]


def _waveform(pieces):
    """One array from the sample slices of a window (first_sample, samples)."""
    first = pieces["first_sample"].to_pylist()
    slices = [
        part.values.to_numpy()[low:high]
        for part in pieces["samples"].chunks
        for low, high in zip(part.offsets.to_numpy()[:-1], part.offsets.to_numpy()[1:])]
    return mixed(list(zip(first, slices))), pieces["sample_rate"][0].as_py()


# ------------------------------------------------------------------ speech to text

def transcribe_windows(audio, model: Model, step_ms, tick_factor=100.0, overlap_ms=0):
    """Timed text for window audio (episode_id, idx, first_sample, ...).

    The model takes (samples, sample_rate) and returns (t0, t1, text) triples in
    ticks from the window's start.  Where windows overlap, a segment counts in
    the window whose core holds its midpoint: cores meet in the middle of the
    overlaps.  Gives transcript rows in episode time; ``pos`` orders by window,
    then by position in the model's answer.
    """
    margin, step = overlap_ms / 2000.0, step_ms / 1000.0

    def run(pieces: pa.Table) -> pa.Table:
        wave, rate = _waveform(pieces)
        low = margin if pieces["idx"][0].as_py() else -np.inf
        # Nothing is said after the audio's end, whatever the model puts there.
        last = len(wave) / rate - 1e-9
        answer = []
        for a in model.get()(wave, rate):
            middle = (float(a[0]) + float(a[1])) / (2 * tick_factor)
            if low <= min(middle, last) < step + margin:
                answer.append(a)
        n = len(answer)
        return pa.table({
            "episode_id": pa.array([pieces["episode_id"][0].as_py()] * n, pa.string()),
            "idx": pa.array([pieces["idx"][0].as_py()] * n, pa.int64()),
            "i": pa.array(range(n), pa.int64()),
            "t0": pa.array([float(a[0]) for a in answer], pa.float64()),
            "t1": pa.array([float(a[1]) for a in answer], pa.float64()),
            "text": pa.array([str(a[2]) for a in answer], pa.string())})

    raw = audio.groupBy("episode_id", "idx").applyInArrow(
        run, "episode_id string, idx long, i long, t0 double, t1 double, text string")
    return normalize_segments(raw, tick_factor, F.col("idx") * step_ms / 1000.0).select(
        "episode_id", (F.col("idx") * POSITIONS_PER_PART + F.col("i")).alias("pos"),
        "start", "end", "text")


def normalize_segments(raw, tick_factor=100.0, offset=None):
    """Model ticks (t0, t1) to seconds and stripped text."""
    offset = F.lit(0.0) if offset is None else offset
    return raw.withColumns({
        "start": F.col("t0") / tick_factor + offset,
        "end": F.col("t1") / tick_factor + offset,
        "text": strip(F.col("text"))})


# ------------------------------------------------------------------ turns and voices

TURN_COLUMNS = (
    "episode_id string, chunk_idx int, turn_pos long, start double, end double, "
    "local_label string, global_start double")


def detect_turns(audio, windows, detector: Model, embedder: Model | None = None,
                 min_seconds=2.0):
    """Speaker turns of every window, with an embedding each if asked.

    ``audio`` is window audio; ``windows`` has (episode_id, idx, global_start,
    num_speakers).  The detector takes (samples, sample_rate, num_speakers or
    None) and returns (start, end, local label) triples in window time.  The
    embedder takes (samples, sample_rate) of the padded turn and returns a
    vector; the turn itself keeps its own bounds.  Each window's audio reaches
    one task once, for both models; its length bounds the group.
    """
    def run(pieces: pa.Table, window: pa.Table) -> pa.Table:
        turns, vectors = [], []
        about = window.to_pylist()[0] if window.num_rows else {}
        if pieces.num_rows and not about:
            raise ValueError(
                f"audio of {pieces['episode_id'][0]} after its given length: no window holds it")
        if pieces.num_rows:
            wave, rate = _waveform(pieces)
            turns = list(detector.get()(wave, rate, about["num_speakers"]))
            if embedder is not None and turns:
                bounds = np.array([(t[0], t[1]) for t in turns], dtype="float64")
                low, high = padded(*bounds.T, min_seconds, len(wave) / rate)
                vectors = [
                    np.asarray(embedder.get()(
                        wave[int(round(a * rate)):int(round(b * rate))], rate),
                        dtype="float32").ravel()
                    for a, b in zip(low, high)]
        n = len(turns)
        found = {
            "episode_id": pa.array([about.get("episode_id")] * n, pa.string()),
            "chunk_idx": pa.array([about.get("idx")] * n, pa.int32()),
            "turn_pos": pa.array(range(n), pa.int64()),
            "start": pa.array([float(t[0]) for t in turns], pa.float64()),
            "end": pa.array([float(t[1]) for t in turns], pa.float64()),
            "local_label": pa.array([str(t[2]) for t in turns], pa.string()),
            "global_start": pa.array([about.get("global_start")] * n, pa.float64())}
        if embedder is not None:
            found["embedding"] = pa.array(vectors, pa.list_(pa.float32()))
        return pa.table(found)

    schema = TURN_COLUMNS + (", embedding array<float>" if embedder is not None else "")
    settings = windows.select(
        "episode_id", F.col("idx").cast("int").alias("idx"), "global_start",
        F.col("num_speakers").cast("int").alias("num_speakers"))
    return (
        audio.groupBy("episode_id", "idx")
        .cogroup(settings.groupBy("episode_id", "idx"))
        .applyInArrow(run, schema))


def embed_turns(turns, embedder: Model):
    """Add ``embedding`` to rows that already hold their (padded) audio.

    ``turns`` has samples and sample_rate; the embedder is as in ``detect_turns``.
    """
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = embedder.get()
        for samples, rates in batches:
            yield pd.Series([
                np.asarray(model(np.asarray(s, dtype="float32"), int(r)), dtype="float32").ravel()
                for s, r in zip(samples, rates)])

    return turns.withColumn("embedding", embed("samples", "sample_rate"))


# ------------------------------------------------------------------ text generation

def http_text_model(name, url, body, answer, timeout=120):
    """A model behind an HTTP endpoint that speaks JSON.

    ``body(prompt)`` builds what is posted and ``answer(reply)`` picks the text
    out of what comes back, so any service can be asked.  An HTTP error or a
    timeout fails the task.  ``name`` tells loaded models apart.
    """
    def load():
        def ask(prompt):
            request = urllib.request.Request(
                url, data=json.dumps(body(prompt)).encode(),
                headers={"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return answer(json.load(reply))
        return ask
    return Model(f"http:{name}:{url}", load)


def generate(prompts, model: Model, concurrency=None):
    """Add ``response`` to every row with a ``prompt``.

    The model takes a prompt and returns text.  ``concurrency`` bounds how many
    tasks ask at once.  Answers may differ between calls, so settle the result
    before using it more than once.
    """
    schema = prompts.drop("response").schema.add("response", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = model.get()
        for batch in batches:
            if "response" in batch.schema.names:
                batch = batch.drop_columns(["response"])
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                answers = [ask(p) for p in some["prompt"].to_pylist()]
                yield some.append_column("response", pa.array(answers, pa.string()))

    if concurrency:
        prompts = prompts.repartition(concurrency)
    return prompts.mapInArrow(run, schema)


def answers_in(spark, path):
    """The answer table at ``path`` (model, prompt_digest, response); empty before the
    first answer."""
    kinds = "model string, prompt_digest string, response string"
    try:
        return spark.read.schema(kinds).parquet(path)
    except AnalysisException:  # no such folder yet
        return spark.createDataFrame([], kinds)


def generate_into(prompts, model: Model, path, concurrency=None, at_once=PROMPTS_AT_ONCE):
    """``generate`` through an answer table that outlives a failure.

    Every distinct prompt without an answer of this model (by name) is asked once,
    in batches of about ``at_once`` that are appended to the table at ``path`` as
    they end.  After a failure the next call asks only what is still open: the
    answers of finished batches stay, those of the batch that failed are asked for
    again.  Rows with equal prompts share an answer; a null prompt has none.
    """
    spark = prompts.sparkSession
    digest = F.sha2("prompt", 256)
    open_ = settle(
        prompts.where("prompt is not null").select("prompt").distinct()
        .withColumn("prompt_digest", digest)
        .join(answers_in(spark, path).where(F.col("model") == model.name),
              "prompt_digest", "left_anti"), "open-prompts")
    batches = -(-open_.count() // at_once)
    for number in range(batches):
        some = open_.where(F.pmod(F.xxhash64("prompt_digest"), F.lit(batches)) == number)
        generate(some, model, concurrency).select(
            F.lit(model.name).alias("model"), "prompt_digest", "response"
        ).write.mode("append").parquet(path)
    known = answers_in(spark, path).where(F.col("model") == model.name).groupBy(
        "prompt_digest").agg(F.min("response").alias("response"))
    return prompts.drop("response").withColumn("prompt_digest", digest).join(
        known, "prompt_digest", "left").drop("prompt_digest")


# ------------------------------------------------------------------ person extraction

def with_entities(table, column, model: Model):
    """Add ``entities`` (array of text, label) found in a text column.

    The model takes a text and returns (text, label) pairs.
    """
    @F.pandas_udf("array<struct<text:string,label:string>>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = model.get()
        for texts in batches:
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                yield pd.Series([
                    [{"text": t, "label": k} for t, k in find(text)]
                    for text in texts.iloc[at:at + TEXTS_AT_ONCE]])

    return table.withColumn("entities", extract(column))


# ------------------------------------------------------------------ model answers

VALUE = "struct<kind:string,text:string>"
ANSWER = f"struct<kind:string,items:array<map<string,{VALUE}>>>"


# What can be wrong with an answer or an element of it.
NOT_JSON, NOT_A_LIST = "not JSON", "not a list"
NO_SPEAKER, NO_CONFIDENCE = "no speaker", "confidence is not a number"


def _members(answer):
    """The JSON text's type and, for an array, the members of its objects as typed text."""
    try:
        data = json.loads(answer)
    except ValueError:
        return {"kind": None, "items": []}
    items = [
        {name: {"kind": type(value).__name__, "text": str(value)} for name, value in item.items()}
        if isinstance(item, dict) else {} for item in (data if isinstance(data, list) else [])]
    return {"kind": type(data).__name__, "items": items}


def parse_proposals(answers, strict=False):
    """Rows (episode_id, pass, pos, speaker_id, ...) from (episode_id, pass, response).

    Only an answer that is a JSON array holds proposals.  Each object with a
    speaker_id is one, unless its confidence is not a number; other elements are
    skipped on their own.  ``strict`` fails on an answer that is a bare number,
    boolean or null.  Settle the result if it is used more than once.
    """
    return without_faults(read_proposals(answers, strict))


def without_faults(proposals):
    """The proposals among the rows of ``read_proposals``."""
    return proposals.where(F.col("fault").isNull()).drop("fault")


def fault_counts():
    """Aggregates by name over the rows of ``read_proposals``."""
    def number(condition):
        return F.count_if(F.coalesce(condition, F.lit(False)))
    fault = F.col("fault")
    return {
        "proposals": number(fault.isNull()), "answers_not_json": number(fault == NOT_JSON),
        "answers_not_a_list": number(fault == NOT_A_LIST),
        "elements_without_speaker": number(fault == NO_SPEAKER),
        "elements_without_confidence": number(fault == NO_CONFIDENCE)}


def read_proposals(answers, strict=False):
    """What ``parse_proposals`` gives and what it skips, with the ``fault``.

    An answer that is not a JSON array is one row with its fault and no ``pos``; an
    element that is no proposal keeps its place and what was readable of it.  An
    empty array has no row.
    """
    @F.pandas_udf(ANSWER)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_members(t) for t in texts], columns=["kind", "items"])

    parsed = computed_once(answers.select(
        "episode_id", "pass",
        read(strip(F.coalesce("response", F.lit("")))).alias("answer")))
    if strict:
        complaint = F.concat(F.lit("answer is not a list, episode "), F.col("episode_id"))
        bare = F.coalesce(F.col("answer.kind").isin("int", "float", "bool", "NoneType"), F.lit(False))
        parsed = parsed.where(
            F.when(bare, F.raise_error(complaint).cast("boolean")).otherwise(F.lit(True)))

    def member(name):
        return F.col("item")[name]

    confidence = F.when(member("confidence").isNull(), F.lit(0.0)).when(
        member("confidence")["kind"] == "bool",
        (member("confidence")["text"] == "True").cast("double")).otherwise(
        parse_float(member("confidence")["text"]))
    # One stand-in row for an answer without a list, so that its fault is kept.
    no_list = F.coalesce(F.col("answer.kind") != "list", F.lit(True))
    rows = parsed.select(
        "episode_id", "pass", F.col("answer.kind").alias("kind"), no_list.alias("no_list"),
        F.posexplode(F.when(no_list, F.array(F.create_map().cast(f"map<string,{VALUE}>")))
                     .otherwise(F.col("answer.items"))).alias("pos", "item"))
    return rows.select(
        "episode_id", "pass", F.when(~F.col("no_list"), F.col("pos").cast("long")).alias("pos"),
        member("speaker_id")["text"].alias("speaker_id"),
        strip(F.coalesce(member("proposed_name")["text"], F.lit(UNKNOWN))).alias("proposed_name"),
        confidence.alias("confidence"),
        strip(F.coalesce(member("justification")["text"], F.lit(""))).alias("justification"),
        F.when(F.col("kind").isNull(), NOT_JSON).when(F.col("no_list"), NOT_A_LIST)
        .when(member("speaker_id")["text"].isNull(), NO_SPEAKER)
        .when(confidence.isNull(), NO_CONFIDENCE).alias("fault"))
