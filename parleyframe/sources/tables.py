"""Tables that outlive the job step that made them."""

import contextlib
import hashlib
import io
import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parleyframe.schemas import TURNS

# For sessions without a shared checkpoint folder, such as tests.
FOLDER = "parleyframe.working.folder"


def working_folder(spark):
    """The folder that ``spark.checkpoint.dir`` or the setting ``FOLDER`` names.

    All executors must see it; there is no fallback to a folder of one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(FOLDER, None)
    if not named:
        raise ValueError(
            f"set spark.checkpoint.dir (or {FOLDER}) to a folder all executors share")
    return named


def run_folder(spark):
    """A new folder for the tables of one run; ``drop_folder`` removes it."""
    return f"{working_folder(spark).rstrip('/')}/parleyframe/run-{uuid.uuid4().hex}"


def drop_folder(spark, folder):
    """Delete a run's folder and the tables in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _writer(table):
    """A writer of tables between steps; the session's limit of records a file is meant
    for results, and would cut these into as many small files."""
    return table.write.option("maxRecordsPerFile", 0)


def settle(table, name, folder=None):
    """Write a table once, into a run's folder, and read it back.

    Used after steps that must not run twice (model calls, whose answers can
    differ) and for small tables used several times.  The written copy also
    cuts the lineage: a lost executor costs a re-read, not another model call.
    """
    spark = table.sparkSession
    path = f"{folder or run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _writer(table).parquet(path)
    return spark.read.schema(table.schema).parquet(path)


_FIELDS_SHOWN = "spark.sql.debug.maxToStringFields"


def identity(table):
    """Text that tells what a table is computed from: its plan, and the names, sizes
    and times of the files it reads.

    A table of rows from memory is only known to the application that holds them.
    """
    spark, shown = table.sparkSession, io.StringIO()
    before = spark.conf.get(_FIELDS_SHOWN)
    spark.conf.set(_FIELDS_SHOWN, 1_000_000)
    try:
        with contextlib.redirect_stdout(shown):
            table.explain("extended")
    finally:
        spark.conf.set(_FIELDS_SHOWN, before)
    plan = re.sub(r"#\d+L?|plan_id=\d+", "", shown.getvalue())
    known, files = [plan], table.inputFiles()
    if files:
        known.append(str(spark.read.format("binaryFile").load(files).agg(
            F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime")
                                .cast("decimal(20,0)"))).first()))
    if not files or re.search("ExistingRDD|LogicalRDD|LocalRelation|LocalTableScan", plan):
        known += [spark.sparkContext.applicationId, str(table.semanticHash())]
    return "\n".join(known)


class Steps:
    """The settled tables of a run's steps.

    In a folder that the caller names they are kept by step, inputs and parameters
    (models by name), so that a run that starts again after a failure takes over
    what was finished and computes the rest.  Without a name, tables go to a new
    folder and are simply settled.

    ``counts`` has, by step, what was counted while its table was written; a step
    that is taken over brings its counts along.
    """

    def __init__(self, spark, folder=None):
        self.spark, self.named = spark, folder is not None
        self.folder = folder or run_folder(spark)
        self.counts = {}

    @classmethod
    def of(cls, spark, folder):
        return folder if isinstance(folder, cls) else cls(spark, folder)

    def __call__(self, name, build, *inputs, counted=None, **parameters):
        """``build()``, written once and read back; ``inputs`` are the tables and
        ``parameters`` the values it depends on.  ``counted`` are aggregates by name,
        observed on the rows as they are written, so no row is read again for them."""
        seen = Observation() if counted else None

        def watched():
            table = build()
            return table.observe(seen, *(
                c.alias(n) for n, c in counted.items())) if counted else table

        if not self.named:
            table = settle(watched(), name, self.folder)
            self._keep(name, seen and seen.get)
            return table
        known = "\n\n".join([*map(identity, inputs), repr(sorted(parameters.items()))])
        path = f"{self.folder}/{name}-{hashlib.sha256(known.encode()).hexdigest()[:32]}"
        finished = self._finished(path)
        if finished is None:
            table = watched()
            _writer(table).mode("overwrite").parquet(path)
            finished = table.schema, seen and seen.get
            # Written last: its row says that the table is whole.
            self.spark.range(1).select(
                F.lit(table.schema.json()).alias("schema"),
                F.lit(json.dumps(finished[1])).alias("counts")
            ).coalesce(1).write.mode("overwrite").parquet(f"{path}-finished")
        schema, counts = finished
        self._keep(name, counts)
        return self.spark.read.schema(schema).parquet(path)

    def _keep(self, name, counts):
        if counts:
            self.counts[name] = counts

    def _finished(self, path):
        """Schema and counts of a table that is whole, or None."""
        try:
            row = self.spark.read.schema("schema string, counts string").parquet(
                f"{path}-finished").first()
        except AnalysisException:  # no such folder yet
            return None
        return row and (
            StructType.fromJson(json.loads(row["schema"])), json.loads(row["counts"] or "null"))


def save_reference(labelled, path, mode="errorifexists"):
    """Store labelled reference turns (episode_id, turn_pos, label, embedding)."""
    labelled.select("episode_id", "turn_pos", "label", "embedding").write.mode(mode).parquet(path)


def load_reference(spark, path):
    kinds = {f.name: f.dataType.simpleString() for f in TURNS}
    return spark.read.schema(
        f"episode_id string, turn_pos bigint, label int, embedding {kinds['embedding']}"
    ).parquet(path)
