"""Audio as tables of fixed-size sample blocks.

A PCM table has one row per (episode_id, channel, block) with ``sample_rate``
and ``samples``; block ``b`` starts at sample ``b * block_samples``.  A PCM
table may also carry ``n_samples``, so that lengths can be read without
touching the samples.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from parleyframe.operators.chunks import _grid, window_indexes

# Samples whose sums are held at once while channels are mixed.
SAMPLES_AT_ONCE = 1 << 18


def audio_duration(pcm):
    """(episode_id, num_frames, sample_rate, seconds) of the longest channel."""
    frames = F.col("n_samples") if "n_samples" in pcm.columns else F.size("samples")
    catalog = pcm.groupBy("episode_id", "channel").agg(
        F.sum(frames).alias("n"), F.max("sample_rate").alias("rate")
    ).groupBy("episode_id").agg(
        F.max("n").alias("num_frames"), F.max("rate").alias("sample_rate"))
    return file_durations(catalog)


def file_durations(catalog):
    """Seconds per file of a catalog with (num_frames, sample_rate)."""
    return catalog.withColumn("seconds", F.col("num_frames") / F.col("sample_rate"))


def blocks_between(pcm, start_sec, end_sec, block_samples, sample_rate):
    """Leave out blocks that hold no sample between two times, as far as a filter
    on literals can tell: recordings at another rate are kept whole."""
    low = math.floor(start_sec * sample_rate / block_samples)
    high = math.ceil(end_sec * sample_rate / block_samples)
    return pcm.where(
        (F.col("sample_rate") != sample_rate)
        | ((F.col("block") >= low) & (F.col("block") < high)))


def clip_pcm(pcm, start_sec, duration_sec, block_samples, sample_rate=None):
    """Samples from ``start_sec`` on, for ``duration_sec``; both bounds are cut
    at the end of the recording.  ``first_sample`` counts from the clip's start.

    When the usual ``sample_rate`` is named, its block range is a literal filter
    that reaches the scan; recordings at another rate are clipped by their own.
    """
    if sample_rate is not None:
        pcm = blocks_between(
            pcm, start_sec, start_sec + duration_sec, block_samples, sample_rate)
    low = F.lit(start_sec) * F.col("sample_rate")
    high = F.lit(start_sec + duration_sec) * F.col("sample_rate")
    begin = F.col("block") * block_samples
    skip = F.greatest(F.lit(0), low - begin)
    keep = F.least(F.size("samples").cast("long"), high - begin) - skip
    return (
        pcm.withColumn("_skip", skip.cast("int")).withColumn("_keep", keep.cast("int"))
        .where(F.col("_keep") > 0)
        .withColumn("first_sample", begin + F.col("_skip") - low)
        .withColumn("samples", F.slice("samples", F.col("_skip") + 1, F.col("_keep")))
        .drop("_skip", "_keep"))


def mixed(slices, at_once=SAMPLES_AT_ONCE):
    """One array from (first sample, samples) slices of any channels: every
    sample is the mean over the channels that have it.

    Sums are held for ``at_once`` samples at a time, so a long window needs little
    more than the array it becomes.
    """
    touching = {}
    for first, x in slices:
        for part in range(first // at_once, -(-(first + len(x)) // at_once)):
            touching.setdefault(part, []).append((first, x))
    out = np.zeros(max((first + len(x) for first, x in slices), default=0), "float32")
    for part, some in touching.items():
        low = part * at_once
        total = np.zeros(min(at_once, len(out) - low))
        seen = np.zeros(len(total))
        for first, x in some:
            begin, end = max(first, low), min(first + len(x), low + len(total))
            total[begin - low:end - low] += x[begin - first:end - first]
            seen[begin - low:end - low] += 1
        out[low:low + len(total)] = total / np.maximum(seen, 1)
    return out


def mixdown_pcm(pcm):
    """Mean over channels, block by block, by the rule windows are mixed with; a
    single channel passes unchanged.

    A group is the channels of one block, which an audio file's header bounds.
    """
    same = [c for c in ("sample_rate", "first_sample") if c in pcm.columns]
    blocks = pcm.groupBy("episode_id", "block").agg(
        *[F.max(c).alias(c) for c in same], F.collect_list("samples").alias("channels"))

    def summed(value):
        # The shorter array is filled up with nulls.
        return F.aggregate("channels", F.array().cast("array<double>"), lambda total, x: F.zip_with(
            total, x, lambda t, s: F.coalesce(t, F.lit(0.0)) + value(s)))

    total = summed(lambda s: F.coalesce(s.cast("double"), F.lit(0.0)))
    seen = summed(lambda s: F.when(s.isNull(), 0.0).otherwise(1.0))
    mean = F.zip_with(total, seen, lambda t, n: F.try_divide(t, n).cast("float"))
    mixed = F.when(F.size("channels") == 1, F.col("channels")[0]).otherwise(mean)
    return blocks.select("episode_id", "block", *same, mixed.alias("samples"))


def chunk_audio(pcm, block_samples, chunk_minutes=10, overlap_seconds=30):
    """Cut blocks into the windows of ``chunk_windows``.

    Gives (episode_id, channel, idx, first_sample, sample_rate, samples) where
    ``first_sample`` counts from the window's start.  Channels stay apart (a
    mixed table has none): the models mix them when they assemble a window,
    which spares long audio a shuffle of its own.  Each block finds its
    windows from the grid; blocks across a window's edge are sliced.  A clip's
    blocks say where they start in ``first_sample``.
    """
    length_ms, step_ms = _grid(chunk_minutes, overlap_seconds)

    def samples_of(ms):
        return F.floor(ms * F.col("sample_rate") / 1000.0)

    begin = (F.col("first_sample") if "first_sample" in pcm.columns
             else F.col("block") * block_samples)
    end = begin + F.size("samples")
    per_ms = F.col("sample_rate") / 1000.0
    until = F.ceil(end / per_ms)
    indexes = window_indexes(F.floor(begin / per_ms), until, until, length_ms, step_ms)
    low, high = samples_of(F.col("idx") * step_ms), samples_of(F.col("idx") * step_ms + length_ms)
    skip = F.greatest(F.lit(0), low - begin)
    keep = F.least(end, high) - begin - skip
    return (
        pcm.where(F.size("samples") > 0)
        .withColumn("idx", F.explode(indexes))
        .withColumn("_skip", skip.cast("int")).withColumn("_keep", keep.cast("int"))
        .where(F.col("_keep") > 0)
        .select(
            "episode_id", *[c for c in ("channel",) if c in pcm.columns],
            F.col("idx").cast("int").alias("idx"),
            (begin + F.col("_skip") - low).alias("first_sample"), "sample_rate",
            F.slice("samples", F.col("_skip") + 1, F.col("_keep")).alias("samples")))


def write_chunk_audio(chunks, path, mode="errorifexists"):
    """Store window audio, clustered by (episode, window)."""
    (chunks.repartitionByRange("episode_id", "idx", "first_sample")
     .sortWithinPartitions("episode_id", "idx", "first_sample")
     .write.mode(mode).parquet(path))
