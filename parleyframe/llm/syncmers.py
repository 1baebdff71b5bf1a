"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer of ``K`` words is an anchor when the smallest hash among its inner words
is at one of its edges.  Whether it is depends on its own words
alone, so equal passages give equal anchors wherever they stand.  Every anchor
is kept, by the place of its first word and a 64-bit hash; the likeness of two
texts is the Jaccard index of their distinct anchors, counted over all of them.
The ``KEPT`` smallest hashes, cut to 32 bits, are a short fingerprint to find
candidates by; no likeness is computed from it.

A text whose k-mers are no anchors, or with fewer than ``K`` words, has one
anchor, its whole word sequence; null counts as empty, without words, without
anchors, like only to another empty one.  Documents follow each other
by descending id (null last), then by key; rows that repeat an id and a text
count as one document and are answered alike.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from parleyframe.llm.common import BLANKS, id_and_text, text_key
from parleyframe.sources.tables import settle

K = 3
KEPT = 48


def _bound(value, body):
    """``body`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positions(hashes):
    """Places of the k-mers that are anchors."""
    def closed(i):
        edges = F.least(F.get(hashes, i), F.get(hashes, i + K - 1))
        middle = [F.get(hashes, i + j) for j in range(1, K - 1)]
        return edges <= (F.least(*middle) if len(middle) > 1 else middle[0])

    return F.when(F.size(hashes) >= K, F.filter(
        F.sequence(F.lit(0), F.size(hashes) - K), closed)).otherwise(
        F.array().cast("array<int>"))


def _kmer(hashes, i):
    return F.xxhash64(*(F.get(hashes, i + j) for j in range(K)))


def _word_hashes(text):
    return F.transform(
        F.filter(F.split(text, BLANKS), lambda w: w != ""), lambda w: F.xxhash64(w))


def anchored(text):
    """Struct of two arrays, position (of the first word, ascending) and hash of
    every anchor of a text."""
    def at(positions, hashes):
        return F.struct(positions.alias("position"), hashes.alias("hash"))

    def of_words(hashes):
        whole = F.size(hashes) > 0
        return _bound(_positions(hashes), lambda found: F.when(F.size(found) > 0, at(
            found, F.transform(found, lambda i: _kmer(hashes, i)))).otherwise(at(
                F.when(whole, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                F.when(whole, F.array(F.xxhash64(hashes))).otherwise(
                    F.array().cast("array<bigint>")))))

    return _bound(_word_hashes(text), of_words)


def sketch(hashes):
    """The smallest anchor hashes of a text, ascending 32-bit integers."""
    short = F.transform(hashes, lambda x: F.shiftright(x, 32).cast("int"))
    return F.slice(F.array_sort(F.array_distinct(short)), 1, KEPT)


def anchors(docs, id_column="doc_id", text_column="text"):
    """doc_id, position (of the first word) and hash of every anchor, for matching
    passages by place."""
    return id_and_text(docs, id_column, text_column).select(
        "doc_id", anchored(F.col("text")).alias("x")).select(
        "doc_id", F.explode(F.arrays_zip("x.position", "x.hash")).alias("x")).select(
        "doc_id", "x.position", "x.hash")


def likeness(n_a, n_b, n_shared):
    """0 to 1, of two texts with so many distinct anchors and so many in common."""
    return F.when((n_a == 0) & (n_b == 0), F.lit(1.0)).otherwise(
        n_shared / (n_a + n_b - n_shared))


def as_text(sketched):
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(
        x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def successors(texts):
    """doc_id, a, b, n_chars and next_id, next_a, next_b of every distinct document.

    Ids are dealt out by range; only the first document of each range meets the
    others, one row a partition.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("a"), F.col("b")]
    ranged = settle(
        texts.select("doc_id", "key.a", "key.b", F.length("text").alias("n_chars")).distinct()
        .repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    place = F.struct("doc_id", "a", "b")
    within = Window.partitionBy("part").orderBy(*order)
    linked = ranged.withColumns({
        "next": F.lead(place).over(within), "number": F.row_number().over(within)})
    firsts = linked.where("number = 1").select("part", place.alias("first"))
    along = Window.orderBy("part")
    after = firsts.select(
        F.col("part").alias("before"), F.coalesce(
            F.lead("first").over(along),
            F.first("first").over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("wrap"))
    following = F.coalesce("next", "wrap")
    return settle(linked.join(after, F.col("part") == F.col("before")).select(
        "doc_id", "a", "b", "n_chars", following["doc_id"].alias("next_id"),
        following["a"].alias("next_a"), following["b"].alias("next_b")), "successors")


def _id_key(doc_id):
    """The id as text that is never null, so that one shuffle serves joins and groups."""
    return F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))


def compared(docs, id_column="doc_id", text_column="text"):
    """All anchors of every document and of its edited text (the last third
    replaced by the beginning of the next document), as arrays of positions and
    of hashes, short fingerprints, and the exact likeness to the edited text and
    to the next document, with the distinct anchors shared."""
    texts = id_and_text(docs, id_column, text_column).withColumn("key", text_key(F.col("text")))
    follows = successors(texts)
    # Both joins take the same columns of it, so that it is shuffled once.
    flat = texts.select(_id_key("doc_id").alias("id"), "key.a", "key.b", "text")
    # What a document gives to the one before it: its text, of which some
    # characters are the edit.
    wanted = follows.select(
        "doc_id", _id_key("doc_id").alias("to_id"), F.col("a").alias("to_a"), F.col("b").alias("to_b"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("cut"), _id_key("next_id").alias("id"),
        F.col("next_a").alias("a"), F.col("next_b").alias("b"))
    given = flat.join(wanted, ["id", "a", "b"]).select(
        F.col("to_id").alias("id"), F.col("to_a").alias("a"), F.col("to_b").alias("b"),
        "doc_id", "cut", F.col("text").alias("next_text")).dropDuplicates(["id", "a", "b"])
    edited = F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - F.col("cut")),
        F.col("next_text").substr(F.lit(1), F.col("cut")))
    joined = flat.join(given, ["id", "a", "b"]).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"),
        anchored(F.col("text")).alias("own"), F.array_distinct(
            anchored(F.col("next_text"))["hash"]).alias("next_set")).withColumn(
        "changed", anchored(F.col("edited")))
    counted = joined.withColumns({
        "own_set": F.array_distinct("own.hash"), "changed_set": F.array_distinct("changed.hash"),
    }).withColumns({
        "shared_edited": F.size(F.array_intersect("own_set", "changed_set")).cast("long"),
        "shared_next": F.size(F.array_intersect("own_set", "next_set")).cast("long")})
    n_own, n_changed, n_next = map(F.size, ("own_set", "changed_set", "next_set"))
    return counted.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(sketch(F.col("own_set"))).alias("fingerprint"),
        as_text(sketch(F.col("changed_set"))).alias("edited_fingerprint"),
        likeness(n_own, n_changed, F.col("shared_edited")).alias("near_edited"),
        likeness(n_own, n_next, F.col("shared_next")).alias("near_next"),
        "shared_edited", "shared_next",
        F.col("own.position").alias("positions"), F.col("own.hash").alias("anchors"),
        F.col("changed.position").alias("edited_positions"),
        F.col("changed.hash").alias("edited_anchors"))
