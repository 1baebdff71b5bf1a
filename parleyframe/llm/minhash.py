"""Near duplicates by minwise signatures, joined by a multi-index over their chunks.

A document is the set of its distinct shingles of three words, as 64-bit hashes.
Its signature has ``SYMBOLS`` minimal hashes cut to 16 bits each.  Signatures
that differ in at most ``RADIUS`` symbols are candidates: of ``CHUNKS`` chunks
one at least then holds ``RADIUS // CHUNKS`` errors or fewer, and every way to
place these errors (symbols left out of the chunk) is a key of the signature, so
that each such pair meets under some key.  A pair whose sets share 85 % or more
is within the radius but for one in 4e9 (test_radius works this out).

Nothing in a group is emitted as pairs.  The documents under a key are compared
by their signatures in one batch, which passes on only links that join what was
apart; so come clusters of candidates, whose full sets are compared in the same
way and decide alone about links.  Groups over a size are compared with one
member first; those that this does not join to it are then compared with all of
the group, block by block.

Equal sets are one document until the end.  A null text, or one without words,
has an empty set and is linked with nothing.  Rows that repeat an id are answered
one by one, by their texts; a null id names a component only if all ids in it are
null.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text, map_batches, text_key
from parleyframe.llm.components import components
from parleyframe.sources.tables import settle

SHINGLE = 3
#: Linked from this percentage of the union on.
PERCENT = 85
SYMBOLS, CHUNKS, RADIUS = 60, 15, 29
#: Bytes of signatures and of sets that are compared in one batch.
SIGNATURE_BYTES, SET_BYTES = 256_000, 4_000_000
_WIDTH = SYMBOLS // CHUNKS
_ERRORS = RADIUS // CHUNKS
_CACHED, _AT_ONCE = 500_000, 1024

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd
_FACTORS = np.random.default_rng(12).integers(0, 2 ** 63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)


# ------------------------------------------------------------------ sets and signatures

class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word):
        if len(self) >= _CACHED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


def shingles(text, cache):
    """The set of a text (bytes): ascending distinct 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.array([], np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out * _STEP + hashes[i:len(hashes) - width + 1 + i])
    return np.unique(out)


def signature(hashes):
    """``SYMBOLS`` numbers of 16 bits of a set that is not empty."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _AT_ONCE):
        least = np.minimum(least, _mixed(
            hashes[at:at + _AT_ONCE, None] * _FACTORS).min(axis=0))
    return least.astype(np.uint16)


def _id_hash(doc_id):
    return F.xxhash64(doc_id.cast("string"))


def signed(docs, id_column="doc_id", text_column="text"):
    """doc_id, ih, ka, kb (hashes of the id and the text), n, a, b (digest of the set)
    and signature of every row."""
    def run(batch):
        cache, n, digests, out = _Words(), [], [], []
        for text in batch["text"].cast(pa.binary()):
            found = shingles(text.as_py(), cache)
            n.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            out.append(signature(found).tobytes() if len(found) else None)
        a, b = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        return pa.table({
            **{name: batch[name] for name in ("doc_id", "ih", "ka", "kb")},
            "n": pa.array(n, pa.int64()), "a": pa.array(a), "b": pa.array(b),
            "signature": pa.array(out, pa.binary())})

    texts = id_and_text(docs, id_column, text_column)
    key = text_key(F.col("text"))
    texts = texts.select("doc_id", "text", _id_hash(F.col("doc_id")).alias("ih"),
                         key["a"].alias("ka"), key["b"].alias("kb"))
    return map_batches(texts, run, (
        f"doc_id {dict(texts.dtypes)['doc_id']}, ih bigint, ka bigint, kb bigint, n bigint, "
        "a bigint, b bigint, signature binary"))


# ------------------------------------------------------------------ keys

def chunk_keys(signatures):
    """All keys of each signature (a row of symbols): the number of the chunk and of
    the symbols left out, then the symbols that stay."""
    keys = []
    for chunk in range(CHUNKS):
        for kept in combinations(range(_WIDTH), _WIDTH - _ERRORS):
            key = np.full(len(signatures), len(keys), np.int64)
            for i in kept:
                key = key << 16 | signatures[:, chunk * _WIDTH + i].astype(np.int64)
            keys.append(key)
    return np.stack(keys, axis=1)


def _symbols(column):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keyed(nodes):
    def run(batch):
        keys = chunk_keys(_symbols(batch["signature"]))
        return pa.table({
            "grp": pa.array(keys.ravel()),
            "node": pa.array(np.repeat(batch["node"].to_numpy(), keys.shape[1]))})
    return map_batches(nodes.select("node", "signature"), run, "grp bigint, node bigint")


# ------------------------------------------------------------------ comparing groups

def _near_signatures(loads):
    symbols = np.frombuffer(b"".join(loads), np.uint16).reshape(-1, SYMBOLS)
    return lambda one, others: (symbols[others] != symbols[one]).sum(axis=1) <= RADIUS


def _near_sets(loads):
    sets = [np.frombuffer(load, np.uint64) for load in loads]
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]

    def near(one, others):
        low, high = (np.searchsorted(every, sets[one], side) for side in ("left", "right"))
        many = high - low
        places = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owner[places], minlength=len(sets))[others]
        return 100 * both >= PERCENT * (sizes[one] + sizes[others] - both)
    return near


LEFT, RIGHT, BOTH = range(3)
MEMBERS = "array<struct<node:bigint,label:bigint,side:int,load:binary>>"


def _joined(groups, compare):
    """Links that join what has different labels, of each group (column ``members``):
    its left members against the right ones."""
    def run(batch):
        a, b = [], []
        for row in batch["members"]:
            members = row.values
            node, side = (members.field(x).to_numpy() for x in ("node", "side"))
            label = members.field("label").to_numpy().copy()
            near = compare(members.field("load").to_pylist())
            right = np.flatnonzero(side != LEFT)
            for one in np.flatnonzero(side != RIGHT):
                others = right[right > one] if side[one] == BOTH else right
                others = others[label[others] != label[one]]
                if len(others):
                    linked = others[near(one, others)]
                    met, first = np.unique(label[linked], return_index=True)
                    a += [node[one]] * len(met)
                    b += node[linked[first]].tolist()
                    label[np.isin(label, met)] = label[one]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return map_batches(groups.select("members"), run, "a bigint, b bigint")


def _gathered(rows, *by):
    """One row a group; groups are bounded by the caller."""
    return rows.groupBy(*by).agg(F.collect_list(
        F.struct("node", "label", "side", "load")).alias("members"))


def links_within(members, compare, most, name):
    """Links that join all near members (grp, node, load) of each group, without
    emitting their pairs.  ``most`` bytes are compared in one batch."""
    size = F.octet_length("load") + 8
    sizes = settle(members.groupBy("grp").agg(
        F.count("*").alias("n"), F.min("node").alias("pivot"),
        F.ceil(F.sum(size) / most).cast("int").alias("parts")).where("n > 1"), f"{name}-sizes")
    placed = settle(members.join(sizes, "grp").withColumn("label", F.col("node")), f"{name}-members")
    small = settle(_joined(_gathered(
        placed.where("parts = 1").withColumn("side", F.lit(BOTH)), "grp"), compare), f"{name}-links")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    large = placed.where("parts > 1").withColumn("part", part)
    if sizes.where("parts > 1").isEmpty():
        return small
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pivots = large.where("node = pivot")
    star = settle(_joined(_gathered(
        large.withColumn("side", F.lit(RIGHT)).unionByName(
            pivots.withColumn("part", every_part).withColumn("side", F.lit(LEFT))),
        "grp", "part"), compare), f"{name}-star")
    roots = settle(components(star, f"{name}-star-links"), f"{name}-star-roots")
    labelled = settle(large.join(roots, "node", "left").withColumn(
        "label", F.coalesce("root", "node")).drop("root"), f"{name}-labelled")
    main = labelled.where("node = pivot").select("grp", F.col("label").alias("main"))
    apart = labelled.join(main, "grp").where("label <> main").drop("main")
    shares = settle(apart.groupBy("grp").agg(
        F.ceil(F.sum(size) / most).cast("int").alias("shares")), f"{name}-apart")
    own = F.pmod(F.xxhash64(F.lit("share"), "node"), F.col("shares")).cast("int")
    every_share = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    blocks = labelled.join(shares, "grp").withColumn("share", every_share).withColumn(
        "side", F.lit(RIGHT)).unionByName(
        apart.join(shares, "grp").withColumn("share", own).withColumn("part", every_part)
        .withColumn("side", F.lit(LEFT)))
    rest = settle(_joined(_gathered(blocks, "grp", "part", "share"), compare), f"{name}-rest")
    return small.unionByName(star).unionByName(rest)


# ------------------------------------------------------------------ documents

def candidates(nodes):
    """Links that join all nodes whose signatures are within the radius."""
    crowded = settle(_keyed(nodes).groupBy("grp").agg(
        F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
        .where("n > 1"), "shared-chunks")
    loads = nodes.select("node", F.col("signature").alias("load"))
    # Most keys are shared by two, often the same two under many keys.
    twos = crowded.where("n = 2").select("low", "high").distinct().select(
        F.xxhash64("low", "high").alias("grp"), F.explode(F.array("low", "high")).alias("node"))
    more = _keyed(nodes).join(crowded.where("n > 2").select("grp"), "grp").select(
        # A key has fewer than 55 bits, so the two kinds of groups stay apart.
        F.col("grp"), "node")
    two = links_within(twos.join(loads, "node"), _near_signatures, SIGNATURE_BYTES, "two")
    return two.unionByName(
        links_within(more.join(loads, "node"), _near_signatures, SIGNATURE_BYTES, "chunk"))


def _sets(docs, nodes, id_column, text_column):
    """node and load (its full set), read again from the texts."""
    def run(batch):
        cache = _Words()
        return pa.table({"node": batch["node"], "load": pa.array([
            shingles(text.as_py(), cache).tobytes() for text in batch["text"].cast(pa.binary())],
            pa.binary())})

    texts = id_and_text(docs, id_column, text_column)
    key = text_key(F.col("text"))
    keyed = texts.select("text", _id_hash(F.col("doc_id")).alias("ih"),
                         key["a"].alias("ka"), key["b"].alias("kb"))
    return map_batches(keyed.join(nodes.select("node", "ih", "ka", "kb"), ["ih", "ka", "kb"])
                       .dropDuplicates(["ih", "ka", "kb"]).select("node", "text"),
                       run, "node bigint, load binary")


def near_duplicates(docs, id_column="doc_id", text_column="text"):
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = settle(signed(docs, id_column, text_column), "signatures")
    # Numbered once, when written.
    nodes = settle(rows.where("n > 0").dropDuplicates(["a", "b"]).drop("doc_id", "n").withColumn(
        "node", F.monotonically_increasing_id()), "sets")
    clusters = settle(components(candidates(nodes), "candidate-links"), "clusters")
    members = settle(_sets(
        docs, nodes.join(clusters.select("node"), "node", "left_semi"), id_column, text_column)
        .join(clusters.withColumnRenamed("root", "grp"), "node"), "cluster-sets")
    roots = settle(components(
        links_within(members, _near_sets, SET_BYTES, "set"), "near-links"), "roots")
    lows = settle(rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("low")), "lows")
    named = settle(lows.join(nodes.select("a", "b", "node"), ["a", "b"]).join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named-sets")
    least = settle(named.groupBy("root").agg(F.min("low").alias("component_id")), "components")
    names = settle(named.select("a", "b", "root").join(least, "root").drop("root"), "names")
    answered = rows.select("doc_id", "n", "a", "b").join(names, ["a", "b"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return answered.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))
