"""JSON arrays as their elements, without reading a file in one piece.

No line of a JSON text begins inside a string, so a line says by itself how many
brackets it opens and closes.  Sums over the splits of a file and over the lines
of a split give the depth at each line's end.  Lines up to one that ends outside
all elements form a group: an element of an indented array, or more where
elements share lines.  An array without line ends is one line and one group.

Elements are numbered from 0 in each file.  A file that holds no array, more
than one, or part of one is an error; so are elements without a comma between
them.  (A comma that is missing while one too many stands elsewhere is not
noticed, and Spark's readers pass over a file of no bytes.)
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from parleyframe.sources.lines import EXTENSION, ordered_lines
from parleyframe.sources.tables import settle

#: Groups numbered by one task.
NUMBERED = 100_000


def _bare(line):
    """What a line holds outside its strings."""
    return F.regexp_replace(F.regexp_replace(line, r"\\.", ""), '"[^"]*+"', "")


def _count(text, kinds):
    return F.length(F.regexp_replace(text, f"[^{kinds}]++", "")).cast("long")


def _before(table, by, order, *sums):
    """Sums over the rows before each one, within ``by``; of bounded or narrow groups only."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({
        name: F.coalesce(F.sum(column).over(before), F.lit(0)) for name, column in sums})


def array_elements(spark, path, element):
    """(episode_id, pos, item) for every element of the arrays in files named after
    their episodes; ``element`` is the DDL type of an item."""
    lines = ordered_lines(spark, path).select("episode_id", "line_no.*", "value").where(
        F.col("value").rlike(r"[^\x20\t\r]")).withColumn("bare", _bare(F.col("value")))
    change = _count(F.col("bare"), r"\[{") - _count(F.col("bare"), r"\]}")
    lines = lines.withColumn("change", F.when(
        F.contains("bare", F.lit('"')), F.raise_error(_complaint("a string without an end")).cast(
            "long")).otherwise(change)).drop("bare")
    splits = lines.groupBy("file", "block").agg(
        F.sum("change").alias("change"), F.min("row").alias("head"))
    splits = _before(splits, ["file"], ["block"], ("outer", "change"), ("rank", F.lit(1)))
    _whole_files_only(spark, path, splits)

    placed = _before(
        lines.join(splits.drop("change"), ["file", "block"]), ["file", "block"], ["row"],
        ("inner", "change")).withColumn("depth", F.col("outer") + F.col("inner"))
    starts = (F.col("rank") == 0) & (F.col("row") == F.col("head"))
    right = F.when(starts, F.col("value").rlike(r"^[\x20\t\r]*+\[")).otherwise(F.col("depth") > 0)
    placed = settle(placed.select(
        "episode_id", "file", "block", "row", "value",
        F.when(right, F.col("depth") + F.col("change") <= 1).otherwise(
            F.raise_error(_complaint("text outside the array")).cast("boolean")).cast("long")
        .alias("last")), "array-lines")

    ends = _before(placed.groupBy("file", "block").agg(F.sum("last").alias("last")),
                   ["file"], ["block"], ("groups", "last")).drop("last")
    numbered = _before(placed.join(ends, ["file", "block"]), ["file", "block"], ["row"],
                       ("within", "last"))
    by = F.struct("block", "row", "value")
    groups = numbered.groupBy(
        "episode_id", "file", (F.col("groups") + F.col("within")).alias("number")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(by)), lambda x: x["value"]), "\n")
        .alias("text"))
    return _numbered_elements(settle(_parsed(groups, element), "array-groups"))


def _complaint(fault):
    return F.concat(F.lit("not a JSON array: "), F.col("episode_id"), F.lit(f" has {fault}"))


def _whole_files_only(spark, path, splits):
    """Stop on files whose brackets do not match, or that hold nothing."""
    sums = splits.groupBy("file").agg(F.sum("change").alias("open"))
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_replace(F.col("_metadata.file_name"), EXTENSION, "").alias("episode_id"))
    bad = files.join(sums, "file", "left").where(
        F.coalesce(F.col("open") != 0, F.lit(True))).select("episode_id").limit(1).collect()
    if bad:
        raise ValueError(f"not a JSON array: {bad[0].episode_id} has no end or no start")


def _parsed(groups, element):
    """Groups with their items, and commas counted; brackets and commas at the rims go."""
    text = F.regexp_replace(F.col("text"), r"^[\x20\t\r\n]++|[\x20\t\r\n]++$", "")
    # The array's own brackets: the first group's first, and the last at depth 0.
    opened = F.when(F.col("number") == 0, F.regexp_replace(text, r"^\[[\x20\t\r\n]*+", "")).otherwise(text)
    table = groups.withColumn("text", opened)
    bare = _bare(F.col("text"))
    closes = _count(bare, r"\]}") > _count(bare, r"\[{")
    table = table.withColumn("text", F.when(
        closes, F.regexp_replace("text", r"[\x20\t\r\n]*+\]$", "")).otherwise(F.col("text")))
    lead, trail = F.col("text").startswith(","), F.rtrim("text").endswith(",") & (
        F.length(F.trim("text")) > 1)
    table = table.withColumns({"lead": lead, "trail": trail}).withColumn(
        "text", F.regexp_replace("text", r"^,|,$", ""))
    items = F.from_json(
        F.concat(F.lit("["), F.col("text"), F.lit("]")), f"array<{element}>", {"mode": "FAILFAST"})
    return table.select(
        "episode_id", "file", "number", items.alias("items"),
        (F.col("lead").cast("long") + F.col("trail").cast("long")).alias("commas"))


def _numbered_elements(groups):
    sized = groups.withColumn("n", F.size("items").cast("long")).withColumn(
        "part", F.floor(F.col("number") / NUMBERED))
    joins = F.count_if(F.col("n") > 0) - 1
    wrong = sized.groupBy("file", "episode_id").agg(
        F.sum("commas").alias("commas"), F.greatest(joins, F.lit(0)).alias("joins")).where(
        F.col("commas") != F.col("joins")).select("episode_id").limit(1).collect()
    if wrong:
        raise ValueError(f"not a JSON array: {wrong[0].episode_id} has too many or too few commas")
    parts = _before(sized.groupBy("file", "part").agg(F.sum("n").alias("n")), ["file"], ["part"],
                    ("earlier", "n")).drop("n")
    placed = _before(sized.join(parts, ["file", "part"]), ["file", "part"], ["number"],
                     ("within", "n"))
    return placed.select(
        "episode_id", (F.col("earlier") + F.col("within")).alias("first"),
        F.posexplode("items").alias("at", "item")).select(
        "episode_id", (F.col("first") + F.col("at")).alias("pos"), "item")
