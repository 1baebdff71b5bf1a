"""What is known about each speaker of an episode."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from parleyframe.functions.intervals import duration

SHARDS = 64
SPEAKER_KEY = ("episode_id", "speaker")


def first_rows(table, keys, order, n, shards=SHARDS):
    """The first ``n`` rows per key in the given order.

    Ranked twice: within shards made of input partitions, then over the few
    rows that are left.  Spark drops rows beyond ``n`` before each shuffle, so a
    key that holds much of the table still reaches its last task as at most
    ``n * shards`` rows.
    """
    shard = [*keys, "_shard"]
    sharded = table.withColumn("_shard", F.spark_partition_id() % shards)
    for part in (shard, list(keys)):
        ranked = sharded.withColumn(
            "_rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
        sharded = ranked.where(F.col("_rank") <= n).drop("_rank")
    return sharded.drop("_shard")


def quote_rows(utterances, n_start, n_end):
    """First and last utterances per speaker, one per row.

    ``part`` 0 holds the first ``n_start`` rows and part 1 the last ``n_end``;
    a row can be in both.  ``n_end = 0`` means all rows, not none.  Read in
    (part, start, pos) order.
    """
    slim = utterances.select("episode_id", "speaker", "start", "pos", "text")
    head = first_rows(slim, SPEAKER_KEY, ["start", "pos"], n_start)
    tail = slim if n_end == 0 else first_rows(
        slim, SPEAKER_KEY, [F.desc("start"), F.desc("pos")], n_end)
    return head.withColumn("part", F.lit(0)).unionByName(tail.withColumn("part", F.lit(1)))


def sample_quotes(utterances, n_start=50, n_end=50):
    """(episode_id, speaker, sample_quotes): first and last texts as one array.

    With ``n_end = 0`` the array holds all texts of a speaker.
    """
    rows = quote_rows(utterances, n_start, n_end)
    return (
        rows.groupBy("episode_id", "speaker")
        .agg(F.array_sort(F.collect_list(F.struct("part", "start", "pos", "text"))).alias("q"))
        .select("episode_id", "speaker", F.col("q.text").alias("sample_quotes")))


def speaker_stats(utterances):
    return utterances.groupBy("episode_id", "speaker").agg(
        F.sum(duration(F.col("start"), F.col("end"))).alias("total_duration"),
        F.count("*").alias("total_turns"),
        F.min("start").alias("first_start"),
        F.max("end").alias("last_end"),
        F.min_by("pos", F.struct("start", "pos")).alias("first_pos"))


def speaker_profiles(utterances, n_start=50, n_end=50):
    """One row per speaker: totals, bounds and sample quotes.

    Speakers of an episode are ordered by (first_start, first_pos), their first
    appearance.
    """
    quotes = sample_quotes(utterances, n_start, n_end)
    return (
        speaker_stats(utterances).join(quotes, ["episode_id", "speaker"])
        .select(
            "episode_id", F.col("speaker").alias("speaker_id"), "total_duration",
            "total_turns", "first_start", "last_end", "sample_quotes", "first_pos"))
