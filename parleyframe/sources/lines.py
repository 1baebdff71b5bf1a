"""Text files as ordered lines, without reading a file in one piece."""

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleyframe.sources.tables import drop_folder, run_folder, settle

EXTENSION = r"\.[^.]*$"
#: Without Hadoop's native library the local file system starts a process for the
#: permissions of every file and another for its checksum file; the raw one starts none
#: and writes no checksums.  Other file systems take no notice.
MANY_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
              "fs.file.impl.disable.cache": "true"}
#: Spark lists every folder in a task of its own, up to this number of tasks.
_LISTING, _LISTED_AT_ONCE = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4
#: Spark takes opening a file for reading 4 MB, so a task reads 32 small files at most;
#: each task that settles lines writes a file of its own.
_OPENING, _OPENED_FOR, _OPENS_FOR = "spark.sql.files.openCostInBytes", "4194304b", "256k"


def ordered_lines(spark, path, partitioned=False):
    """(episode_id, line_no, value) in one pass.

    The episode is the file name without its extension, or the ``episode_id=``
    directory when ``partitioned``.  ``line_no`` is a struct (file, block, row)
    that compares like the place of the line: files by name, then splits of a
    file by offset, then rows of a split.
    """
    reader = spark.read
    if partitioned:
        # Declared, because inference would turn an id such as "007" into 7.
        reader = reader.schema(T.StructType([
            T.StructField("value", T.StringType()),
            T.StructField("episode_id", T.StringType())]))
        episode = F.col("episode_id")
    else:
        episode = F.regexp_replace(F.col("_metadata.file_name"), EXTENSION, "")
    with _listing_in_few_tasks(spark):
        files = reader.text(path)
    return files.select(
        episode.alias("episode_id"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")).alias("line_no"),
        "value")


@contextmanager
def _listing_in_few_tasks(spark):
    """A few listing tasks a core for any number of folders."""
    kept = int(spark.conf.get(_LISTING))
    few = _LISTED_AT_ONCE * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING, min(kept, few))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, kept)


@contextmanager
def _small_files_in_few_tasks(spark):
    """More small files a task, unless the session sets another cost than Spark's own."""
    kept = spark.conf.get(_OPENING)
    if kept == _OPENED_FOR:
        spark.conf.set(_OPENING, _OPENS_FOR)
    try:
        yield
    finally:
        if kept == _OPENED_FOR:
            spark.conf.unset(_OPENING)


def numbered_lines(spark, path, partitioned=False):
    """The same with ``line_no`` counting from 0 within each episode.

    A large file is read as many splits.  The rows are settled with their places,
    and the row count of every split gives the number of lines before it, so no
    task ever sees more than one split.  ``ordered_lines`` does without where the
    order alone is enough.
    """
    with _small_files_in_few_tasks(spark):
        rows = settle(ordered_lines(spark, path, partitioned).select(
            "episode_id", "line_no.*", "value"), "lines")
    before = (Window.partitionBy("episode_id").orderBy("file", "block")
              .rowsBetween(Window.unboundedPreceding, -1))
    splits = (
        rows.groupBy("episode_id", "file", "block")
        .agg(F.min("row").alias("first"), F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("file", "block", "first", "before"))
    return rows.join(splits, ["file", "block"]).select(
        "episode_id", (F.col("before") + F.col("row") - F.col("first")).alias("line_no"), "value")


def computed_once(table):
    """The same rows, with every column evaluated here and only here.

    Spark moves filters on a parsed column below the parsing, repeating it for
    each condition.  Filters do not move below a generator.
    """
    return table.select(F.inline(F.array(F.struct(*table.columns))))


def whole_files(spark, path):
    """(episode_id, value): one row per file, for formats that cannot be split."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.regexp_replace(F.col("_metadata.file_name"), EXTENSION, "").alias("episode_id"),
                "value"))


def write_lines(lines, path, order, mode="errorifexists", per_episode=False):
    """Write column ``line`` as text, ordered by episode and the ``order`` columns.

    Rows are range-partitioned on (episode, order): a very long episode becomes
    several part files whose names follow its order, and short ones share a
    file.  ``per_episode`` writes a directory for each episode instead, which
    suits a limited number of episodes.

    Spark samples the rows for the bounds of the ranges before it shuffles them,
    so ``lines`` is computed twice; see ``settled_while``.
    """
    ordered = lines.repartitionByRange("episode_id", *order).sortWithinPartitions(
        "episode_id", *order)
    if per_episode:
        ordered.select("episode_id", "line").write.options(**MANY_FILES).mode(mode).partitionBy(
            "episode_id").text(path)
    else:
        ordered.select("line").write.mode(mode).text(path)


@contextmanager
def settled_while(table, name):
    """The rows written out for the time of a ``with`` block, for steps that read them
    more than once; what they come from, such as model calls, runs once."""
    spark = table.sparkSession
    folder = run_folder(spark)
    try:
        yield settle(table, name, folder)
    finally:
        drop_folder(spark, folder)
