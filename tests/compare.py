"""Compare every registered query with its oracle on one data folder.

    python tests/compare.py [folder] [query ...]
"""

import glob
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value if value is None or isinstance(value, (bool, str)) else str(value)


def oracle_rows(folder, sql):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    return names, kinds, result.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple(map(repr, row)))


def compare(spark, folder, name):
    """Message about the first difference, or None."""
    frame = entry.queries()[name](spark, folder)
    rows = frame.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    names, kinds, expected = oracle_rows(folder, sql)
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    mine, theirs = normal(frame.columns, rows), normal(names, expected)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, first {wrong[0]}"[:1200]
    if not mine:
        return "no rows"
    spark_kinds = dict(frame.dtypes)
    known = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    off = {n: (spark_kinds[n], k) for n, k in zip(names, kinds)
           if k in known.values() and known.get(spark_kinds[n], k) != k}
    return f"types {off}" if off else None


def main():
    from pyspark.sql import SparkSession
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-compare-"))
        .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    out = open(os.environ.get("COMPARE_LOG", "/dev/stdout"), "a")
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        begin = time.time()
        try:
            message = compare(spark, folder, name)
        except Exception as problem:
            message = f"{type(problem).__name__}: {str(problem)[:1500]}"
        bad += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name} {time.time() - begin:.1f}s"
              + (f"\n     {message}" if message else ""), file=out, flush=True)
    print(f"{bad} failed", file=out, flush=True)


if __name__ == "__main__":
    main()
