"""Near duplicates by SimHash fingerprints and covering masks.

A 64-bit fingerprint takes the majority bit of the hashes of all shingles of
four words.  Two documents are linked when their fingerprints differ in at most
``RADIUS`` bits.  Bit i is given the vector i % 31 + 1 of five bits; a mask for
each of the 31 non-zero vectors v keeps the bits whose vector has odd overlap
with v.  Four vectors never span five dimensions, so some v has even overlap
with all of them: any four bits are absent together from one mask, and every
pair within the radius agrees under that mask.

A null text, or one without words, has fingerprint zero, linked like any other.
Repeated rows have equal fingerprints and so one component.  A null id never
names a component unless all ids in it are null.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text, map_batches, shuffled, text_key
from parleyframe.llm.components import components
from parleyframe.sources.tables import settle

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Larger groups under one mask are linked through points between them.
PAIRED = 1024

_VECTORS = range(1, 2 ** (RADIUS + 1))
MASKS = [
    sum(1 << bit for bit in range(64) if (v & (bit % 31 + 1)).bit_count() % 2) for v in _VECTORS]


def _signed(bits):
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint(text, at_once=50_000):
    """Fingerprint of one text, an unsigned integer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    begins, ends = begins[:len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), at_once):
        hashes = np.array([
            digest(joined[a:b], SEED)
            for a, b in zip(begins[at:at + at_once], ends[at:at + at_once])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(ends), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs, id_column="doc_id", text_column="text"):
    """doc_id, key (of the text) and fp, a signed 64-bit integer, of every row."""
    def run(batch):
        values = np.array([fingerprint(x.as_py()) for x in batch["text"]], np.uint64)
        return pa.table({"doc_id": batch["doc_id"], "key": batch["key"],
                         "fp": pa.array(values.view(np.int64))})

    texts = id_and_text(docs, id_column, text_column).withColumn("key", text_key(F.col("text")))
    kinds = dict(texts.dtypes)
    return map_batches(
        texts, run, f"doc_id {kinds['doc_id']}, key {kinds['key']}, fp bigint")


def _paired(groups):
    """Each fingerprint of a bounded group (array ``fps``) and the first one that
    links within the group join it to."""
    def run(batch):
        a, b = [], []
        for group in batch["fps"]:
            values = np.sort(np.array(group.values.to_numpy(zero_copy_only=False)))
            bits = values.view(np.uint64)
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS
            unseen = np.ones(len(values), bool)
            for first in range(len(values)):
                if not unseen[first]:
                    continue
                unseen[first] = False
                front = [first]
                while front:
                    found = np.flatnonzero(near[front].any(axis=0) & unseen)
                    unseen[found] = False
                    a += values[found].tolist()
                    b += [int(values[first])] * len(found)
                    front = found.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return map_batches(groups.select("fps"), run, "a bigint, b bigint")


def _between(members):
    """Links within large groups: two fingerprints within the radius are both
    within half of it of some point, so those around a point link to the
    smallest.  Only bits outside the mask differ within a group."""
    spots = [
        F.array(*(F.lit(_signed(sum(1 << bit for bit in bits))) for bits in _flips(mask)))
        for mask in MASKS]
    flips = F.element_at(F.array(*spots), F.col("v") + 1)
    points = members.select("v", "fp", F.explode(flips).alias("flip")).select(
        "v", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    smallest = points.groupBy("v", "point").agg(
        F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").drop("high")
    return points.join(shuffled(smallest), ["v", "point"]).where("fp > low").select(
        F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def _flips(mask):
    free = [bit for bit in range(64) if not mask >> bit & 1]
    return [(), *((x,) for x in free),
            *((x, y) for i, x in enumerate(free) for y in free[:i])]


def links(distinct):
    """Links (a, b) that join all fingerprints (``fp``) within the radius."""
    tables = distinct.select(
        "fp", F.posexplode(F.array(*(
            F.col("fp").bitwiseAND(F.lit(_signed(mask))) for mask in MASKS))).alias("v", "bits"))
    sizes = tables.groupBy("v", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(tables.join(shuffled(sizes), ["v", "bits"]), "shared-masks")
    small = shared.where(F.col("n") <= PAIRED).groupBy("v", "bits").agg(
        F.collect_list("fp").alias("fps"))
    return _paired(small).distinct().unionByName(_between(shared.where(F.col("n") > PAIRED)))


def classes(docs, id_column="doc_id", text_column="text"):
    """``fingerprints`` and, for each fingerprint, its ``root`` fingerprint."""
    prints = settle(fingerprints(docs, id_column, text_column), "fingerprints")
    roots = components(links(prints.select("fp").distinct()), "fingerprint-links")
    return prints, settle(roots.withColumnRenamed("node", "fp"), "fingerprint-roots")


def near_duplicates(docs, id_column="doc_id", text_column="text"):
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints, roots = classes(docs, id_column, text_column)
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(
        roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = named.select("fp", "root").join(low, "root").select("fp", "component_id")
    return prints.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs, id_column="doc_id", text_column="text"):
    """``docs`` with one row of each component: the smallest id (a null id comes
    last), then the smallest text key; rows that repeat it go too."""
    prints, roots = classes(docs, id_column, text_column)
    kept = prints.join(roots, "fp", "left").groupBy(
        F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct(
            F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("k"))
    # Never null, so that one exchange of the rows serves the join and the repeats.
    def place(doc_id, key):
        return [F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).alias("id"),
                key["a"].alias("a"), key["b"].alias("b")]

    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(*place(docs[id_column], text_key(text)), F.struct("*").alias("row"))
    chosen = kept.select(*place(F.col("k.doc_id"), F.col("k.key")))
    by = ["id", "a", "b"]
    return rows.join(chosen, by, "left_semi").dropDuplicates(by).select("row.*")
