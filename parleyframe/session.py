"""Session settings the jobs are written for."""

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

from parleyframe.sources.tables import FOLDER

# Adaptive execution picks partition counts, splits skewed join partitions and
# turns a shuffled join into a broadcast or hash join only when the measured
# sizes allow.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app="parleyframe", master=None, **conf):
    """A session with the recommended settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

_SHIPPED = set()


def ship(spark):
    """Send the package to the Python workers, once per application.

    A session of one machine that names no shared folder, as in tests, gets a
    working folder of its own; a cluster must name one.  Rows that hold whole
    texts or blocks of audio reach Python in batches of ``BATCH_ROWS``, unless
    the session sets another size than Spark's own.
    """
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(), "parleyframe"), "zip", root, "parleyframe")
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(FOLDER, None)
    if not named and re.match(r"local(\[|$)", spark.sparkContext.master):
        spark.conf.set(FOLDER, tempfile.mkdtemp(prefix="parleyframe-"))
