"""Collocations: frequent phrases by multikey quicksort of suffix pointers.

A suffix is the (up to) five words from a place on, within its piece of text.
Suffixes go to buckets by their leading words, all with the same leading words
to the same one; there the pointers to them are sorted by three-way partitions,
word by word down to the fifth.  The size of an equal partition is the count of
the phrase its members begin with, and partitions that are too small to hold a
frequent phrase are abandoned.

Two leading words choose the bucket; where so many suffixes begin with them that
a bucket would grow too large (known from counts over hash cells), three, four or
all five do.  What such a bucket counts about shorter phrases is a part, and parts
are added up.  A map task sends equal suffixes once, with their number.  Suffixes
end before words that are rare themselves, found by exact counts and a bitmap of
fixed size, and between two words whose pair is rare: pairs are counted in hash
cells, so a cell holds no fewer than each of its pairs, and no frequent phrase has
a pair in a cell with fewer than a phrase needs.  Words travel as 64-bit hashes; the
exact table of all words shows whether two share one, and then other hashes are drawn.

Null text is empty, null ``lang`` is ``und``; ids are not used, and repeated rows
count as often as they stand.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from parleyframe.sources.tables import settle

#: The longest phrase, the fewest occurrences, phrases told a language.
LONGEST, LEAST, FIRST = 5, 100, 2000
#: Words a map task counts, and sends to buckets, at once; suffixes a bucket is meant to hold.
UNIT_WORDS, SENT_WORDS, BUCKET = 2_000_000, 1_000_000, 500_000
#: Bits of the bitmap of frequent words, and the fewest cells suffixes are counted in.
BITS, CELLS = 1 << 23, 1 << 16
#: The fewest and the most cells pairs are counted in; their bitmap is broadcast.
PAIR_CELLS, MOST_PAIR_CELLS = 1 << 16, 1 << 28
_SLICE, _PAIR_SLICE, _CHUNK = 4096, 1 << 16, 8_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


# ------------------------------------------------------------------ units of words

class _Names(dict):
    """Numbers of the words of one language in a unit; 0 is a break."""

    def __init__(self, lang, names):
        super().__init__({b".": 0})
        self.lang, self.names = lang, names

    def __missing__(self, word):
        self[word] = number = len(self.names)
        self.names.append((self.lang, word))
        return number


def _tokens(text):
    """Words of a text and ``.`` between pieces, in bounded lists."""
    data, at = text.lower().translate(_BREAKS), 0
    while at < len(data):
        end = len(data)
        if end - at > _CHUNK:
            end = data.rfind(b".", at, at + _CHUNK) + 1 or data.find(b".", at) + 1 or end
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def _units(batches, words):
    """(numbers of words in a row, names) for about ``words`` words at a time."""
    names, by_lang, held, size = [None], {}, [], 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"].cast(pa.binary())):
            lang = lang.as_py()
            if lang not in by_lang:
                by_lang[lang] = _Names(lang, names)
            for tokens in _tokens(text.as_py()):
                held.append(np.fromiter(
                    map(by_lang[lang].__getitem__, tokens), np.int32, len(tokens)))
                held.append(np.zeros(1, np.int32))
                size += len(tokens)
                if size >= words:
                    yield np.concatenate(held), names
                    names, by_lang, held, size = [None], {}, [], 0
                    by_lang[lang] = _Names(lang, names)
    if held:
        yield np.concatenate(held), names


def _hashes(names, seed):
    """64-bit hashes of (language, word); the break is 0."""
    seeds = {lang: xxhash.xxh64_intdigest(lang, seed) for lang in {x[0] for x in names[1:]}}
    return np.array([0, *(xxhash.xxh64_intdigest(word, seeds[lang]) for lang, word in names[1:])],
                    np.uint64)


def _suffixes(ids, keep, pairs=None):
    """Columns of the numbers of the suffixes of two words or more.  They hold words to
    ``keep`` only, and neighbours only for which ``pairs`` (of two columns) is true."""
    x = np.concatenate([np.where(keep[ids], ids, 0), np.zeros(LONGEST, np.int32)])
    linked = (x[:-1] != 0) & (x[1:] != 0)
    if pairs is not None:
        linked[linked] = pairs(x[:-1][linked], x[1:][linked])
    at = np.flatnonzero(linked)
    columns = [x[at], x[at + 1]]
    for i in range(2, LONGEST):
        columns.append(np.where((columns[-1] != 0) & linked[at + i - 1], x[at + i], 0))
    return np.stack(columns)


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


def _longer(mixed, word):
    """The hash of leading words, of those before and the next one."""
    return _mixed(mixed * _STEP + word)


def _leading(columns, hashes):
    """A hash of the first i words of every suffix, for i from 2 on."""
    mixed, out = _mixed(hashes[columns[0]]), []
    for column in columns[1:]:
        mixed = _longer(mixed, hashes[column])
        out.append(mixed)
    return out


# ------------------------------------------------------------------ counting words and cells

COUNTED = "lang string, word string, h bigint, n bigint, slice int, cells binary"


def _tallied(cells, most):
    if most <= 4 * len(cells):
        counts = np.bincount(cells)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(cells, return_counts=True)


def _packed_cells(cells, counts):
    """Sorted cells of a slice as gaps, and the bytes of their counts by place."""
    counts = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.diff(cells, prepend=0).astype("<u2").tobytes() + counts.T.tobytes()


def _unpacked_cells(data):
    data = zstandard.ZstdDecompressor().decompress(data)
    size = len(data) // 6
    counts = np.frombuffer(data, np.uint8, 4 * size, 2 * size).reshape(4, size)
    return (np.cumsum(np.frombuffer(data, "<u2", size), dtype=np.int64),
            np.ascontiguousarray(counts.T).view("<u4").ravel())


def _counted(texts, seed, cells, pair_cells):
    """Words with their hashes and counts, and counts of suffixes by cell, by unit.

    Slices of cells are numbered by level, those of pairs alone after the others.
    """
    slices = cells // _SLICE

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for ids, names in _units(batches, UNIT_WORDS):
            hashes, n = _hashes(names, seed), np.bincount(ids, minlength=len(names))
            size = len(names) - 1
            yield pa.record_batch({
                "lang": pa.array([x[0] for x in names[1:]], pa.string()),
                "word": pa.array([x[1] for x in names[1:]], pa.binary()).cast(pa.string()),
                "h": pa.array(hashes[1:].view(np.int64)), "n": pa.array(n[1:], pa.int64()),
                "slice": pa.nulls(size, pa.int32()), "cells": pa.nulls(size, pa.binary())})
            columns, at, packed = _suffixes(ids, np.ones(len(names), bool)), [], []
            leading = _leading(columns[:-1], hashes)
            for level, (mixed, of, width) in enumerate(
                    [*((x, cells, _SLICE) for x in leading),
                     (leading[0], pair_cells, _PAIR_SLICE)]):
                found, many = _tallied((mixed % np.uint64(of)).astype(np.int64), of)
                edges = np.searchsorted(found, np.arange(of // width + 1) * width)
                for i in np.flatnonzero(np.diff(edges)):
                    some = slice(edges[i], edges[i + 1])
                    at.append(level * slices + int(i))
                    packed.append(pack(_packed_cells(found[some] % width, many[some])))
            n = len(at)
            yield pa.record_batch({
                "lang": pa.nulls(n, pa.string()), "word": pa.nulls(n, pa.string()),
                "h": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int64()),
                "slice": pa.array(at, pa.int32()), "cells": pa.array(packed, pa.binary())})

    return texts.mapInArrow(run, COUNTED)


def _cells(counted, cells, pair_cells, least):
    """Cells (by level) with more suffixes than a bucket takes, no more than there are
    buckets; bits of the cells of pairs with ``least`` or more; the number of suffixes
    that begin in these."""
    slices = cells // _SLICE

    def add(rows: pa.Table) -> pa.Table:
        number = rows["slice"][0].as_py()
        level = min(number // slices, LONGEST - 2)
        at = number - level * slices
        total = np.zeros(_SLICE if level < LONGEST - 2 else _PAIR_SLICE, np.int64)
        for data in rows["cells"]:
            found, many = _unpacked_cells(data.as_py())
            total[found] += many
        if level == LONGEST - 2:
            enough = total >= least
            cell, n = [at], [total[enough].sum()]
            bits = [np.packbits(enough, bitorder="little").tobytes()]
        else:
            hot = np.flatnonzero(total > BUCKET)
            cell, n, bits = at * _SLICE + hot, total[hot], [None] * len(hot)
        return pa.table({
            "level": pa.array([level] * len(cell), pa.int32()), "cell": pa.array(cell, pa.int64()),
            "n": pa.array(n, pa.int64()), "bits": pa.array(bits, pa.binary())})

    found = settle(counted.where("slice is not null").groupBy("slice").applyInArrow(
        add, "level int, cell bigint, n bigint, bits binary").where("n > 0"), "cells")
    hot, total = [[] for _ in range(LONGEST - 2)], 0
    bits = np.zeros((pair_cells // _PAIR_SLICE, _PAIR_SLICE // 8), np.uint8)
    for row in found.toLocalIterator():
        if row["level"] < LONGEST - 2:
            hot[row["level"]].append(row["cell"])
        else:
            bits[row["cell"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
            total += row["n"]
    return [np.array(sorted(x), np.int64) for x in hot], bits.ravel(), total


def _bitmap(words, least):
    """Bits of the hashes of frequent words, of a fixed size."""
    place = F.pmod("h", F.lit(BITS)) + 1
    rows = words.where(F.col("n") >= least).groupBy(
        F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        bits[(row["part"] - 1) * len(part):row["part"] * len(part)] = part
    return bits


# ------------------------------------------------------------------ routing

def _buckets(texts, seed, bits, pair_bits, hot, cells, buckets):
    """(bucket, suffixes): distinct suffixes of a unit with their numbers, packed."""
    spark = texts.sparkSession
    # At most ``BITS`` and ``MOST_PAIR_CELLS`` bits, and a cell for every ``BUCKET`` suffixes.
    shared = spark.sparkContext.broadcast((bits, pair_bits, hot))

    def run(batches):
        frequent, together, full = shared.value
        bitmap = np.unpackbits(frequent, bitorder="little").view(bool)
        pack = zstandard.ZstdCompressor(level=1).compress
        for ids, names in _units(batches, SENT_WORDS):
            hashes = _hashes(names, seed)
            keep = bitmap[hashes.view(np.int64) % BITS]
            keep[0] = False

            def frequent_pair(one, other):
                cell = _longer(_mixed(hashes[one]), hashes[other]) % np.uint64(8 * len(together))
                return together[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1

            columns = _suffixes(ids, keep, frequent_pair)
            leading = _leading(columns, hashes)
            # Those with the same two words side by side; equal ones are told by all words.
            order = np.argsort(leading[0] << np.uint64(32) | leading[-1] >> np.uint64(32))
            columns = columns[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
            starts = np.flatnonzero(new)
            number = np.diff(np.append(starts, len(order))).astype("<u4")
            columns, order = columns[:, starts], order[starts]
            depth = np.full(len(order), 2, np.uint8)
            route = leading[0][order]
            for level, crowded in enumerate(full):
                deeper = (depth == level + 2) & np.isin(
                    (leading[level][order] % np.uint64(cells)).astype(np.int64), crowded)
                depth[deeper] += 1
                route = np.where(deeper, leading[level + 1][order], route)
            to = (_mixed(route) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[by], prepend=-1, append=-1))
            place, out, at = np.zeros(len(names), np.int64), [], []
            for a, b in zip(edges[:-1], edges[1:]):
                rows = by[a:b]
                used = np.flatnonzero(np.bincount(columns[:, rows].ravel(), minlength=len(names)))
                place[used] = np.arange(len(used))
                kind = "<u2" if len(used) < 1 << 16 else "<u4"
                head = np.array([len(rows), len(used)], "<u4").tobytes()
                out.append(head + pack(b"".join([
                    hashes[used].tobytes(), place[columns[:, rows]].astype(kind).tobytes(),
                    number[rows].tobytes(), depth[rows].tobytes()])))
                at.append(int(to[rows[0]]))
            yield pa.record_batch({"bucket": pa.array(at, pa.int64()),
                                   "suffixes": pa.array(out, pa.binary())})

    return texts.mapInArrow(run, "bucket bigint, suffixes binary")


def _unpacked(data):
    rows, used = (int(x) for x in np.frombuffer(data, "<u4", 2))
    body = zstandard.ZstdDecompressor().decompress(data[8:])
    kind = np.dtype("<u2" if used < 1 << 16 else "<u4")
    at = 8 * used
    columns = np.frombuffer(body, kind, LONGEST * rows, at).reshape(LONGEST, rows)
    at += kind.itemsize * LONGEST * rows
    return (np.frombuffer(body, "<u8", used)[columns],
            np.frombuffer(body, "<u4", rows, at).astype(np.int64),
            np.frombuffer(body, np.uint8, rows, at + 4 * rows).astype(np.int64))


# ------------------------------------------------------------------ sorting

def equal_partitions(keys, number, whole, least):
    """(length, one pointer, count) arrays of the phrases in ``keys`` (a row a word, 0
    after the end), each suffix counting ``number`` times.

    All partitions take a three-way step together: around the median of three of
    their next words.  The middle part is an equal partition; its size counts the
    phrase so far, and it goes on with the next word.  A partition with fewer than
    ``least`` is abandoned, unless some of its members (``whole`` leading words
    brought them here) tell of shorter phrases only in part; those parts are told
    whatever their size.
    """
    pointers, sizes = np.arange(keys.shape[1]), np.array([keys.shape[1]])
    depth, told = np.zeros(1, np.int64), []
    while len(pointers):
        partition = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        words = keys[depth[partition], pointers]
        first, middle, last = words[starts], words[starts + sizes // 2], words[starts + sizes - 1]
        pivot = np.maximum(np.minimum(first, middle),
                           np.minimum(np.maximum(first, middle), last))
        side = 1 + (words > pivot[partition]).astype(np.int64) - (words < pivot[partition])
        label = 3 * partition + side
        sizes = np.bincount(label, minlength=3 * len(sizes))
        starts = np.cumsum(sizes) - sizes
        weight = np.bincount(label, number[pointers], len(sizes)).astype(np.int64)
        depth = np.repeat(depth, 3)
        depth[1::3] += 1
        shorter = np.bincount(
            label, whole[pointers] > np.maximum(2, depth[label] + 1), len(sizes)) > 0
        moved = np.empty_like(pointers)
        for i in range(3):
            some = np.flatnonzero(side == i)
            before = np.cumsum(sizes[i::3]) - sizes[i::3]
            moved[starts[label[some]] + np.arange(len(some)) - before[partition[some]]] = pointers[some]
        pointers = moved
        equal = np.arange(1, len(sizes), 3)
        head, length = pointers[starts[equal]], depth[equal]
        said = (length >= 2) & (pivot != 0) & (
            (weight[equal] >= least) | (whole[head] > length))
        told.append((length[said], head[said], weight[equal][said]))
        goes_on = (sizes > 0) & ((weight >= least) | shorter)
        goes_on[equal] &= (pivot != 0) & (length < len(keys))
        pointers = pointers[np.repeat(goes_on, sizes)]
        sizes, depth = sizes[goes_on], depth[goes_on]
    return [np.concatenate([x[i] for x in told]) for i in range(3)]


def _sorted(buckets, least):
    def run(rows: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py()) for x in rows["suffixes"]]
        keys, number, whole = (np.concatenate(x, axis=-1) for x in zip(*parts))
        length, head, count = equal_partitions(keys, number, whole, least)
        flat = keys[:, head].T[np.arange(LONGEST)[None, :] < length[:, None]]
        return pa.table({
            "k": pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()),
                pa.array(flat.view(np.int64))),
            "a": pa.array(count, pa.int64())})

    return buckets.groupBy("bucket").applyInArrow(run, "k array<bigint>, a bigint").groupBy(
        "k").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


# ------------------------------------------------------------------ phrases

def phrases(docs, text_column="text", lang_column="lang", least=LEAST):
    """``words`` (h, lang, word, n) and ``phrases`` (k: hashes of 2 to 5 words, a) of
    which there are ``least`` or more."""
    texts = docs.select(
        F.coalesce(docs[lang_column], F.lit("und")).alias("lang"),
        F.coalesce(docs[text_column], F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # About a word in six bytes, and several cells for every bucket.
    cells = max(CELLS, 1 << (4 * size // BUCKET).bit_length())
    # About a cell for ten pairs, until they are as many as may be.
    pair_cells = min(max(PAIR_CELLS, 1 << (size // 64).bit_length()), MOST_PAIR_CELLS)
    seed = 0
    while True:
        counted = settle(_counted(texts, seed, cells, pair_cells), "counted-words")
        words = settle(counted.where("word is not null").select("h", "lang", "word", "n")
                       .repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n")),
                       "words")
        if words.where("h = 0").isEmpty() and words.groupBy("h").count().where(
                "count > 1").isEmpty():
            break
        seed += 1
    hot, pair_bits, total = _cells(counted, cells, pair_cells, least)
    routed = _buckets(texts, seed, _bitmap(words, least), pair_bits, hot, cells,
                      max(1, -(-total // BUCKET)))
    return words, settle(_sorted(routed, least), "phrases")


def collocations(docs, text_column="text", lang_column="lang", least=LEAST, first=FIRST):
    """lang, rank, phrase, a, l, r, n, score: each language's phrases whose weakest cut
    scores highest, without those that a longer phrase explains."""
    words, found = phrases(docs, text_column, lang_column, least)
    known = settle(words.where(F.col("n") >= least), "frequent-words")
    size = F.size("k")
    # A phrase occurs no less often than one around it, and one a word longer lies
    # between the two: so the next longer ones tell.
    around = settle(found.where(size > 2).select(
        F.explode(F.array(F.slice("k", 1, size - 1), F.slice("k", 2, size - 1))).alias("k"), "a")
        .groupBy("k").agg(F.max("a").alias("longer")), "longer-phrases")
    kept = found.join(around, "k", "left").where(
        F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).drop("longer")
    part = settle(found.unionByName(
        known.select(F.array("h").alias("k"), F.col("n").alias("a"))), "parts")

    def counts(side, name):
        return part.select(F.col("k").alias(side), F.col("a").alias(name))

    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1))).withColumns({
        "head": F.slice("k", 1, F.col("cut")),
        "tail": F.slice("k", F.col("cut") + 1, size - F.col("cut"))})
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    langs = known.select(F.col("h").alias("opening"), "lang").join(totals, "lang")
    cuts = cuts.join(counts("head", "l"), "head").join(counts("tail", "r"), "tail").withColumn(
        "opening", F.col("k")[0]).join(langs, "opening")
    score = F.expr(
        "(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0)))"
        " div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("k", "a", "lang", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("m")).select(
        "k", "a", "lang", "n", "m.score", "m.l", "m.r")
    order = [F.desc("score"), F.desc("a")]
    # Ties at the end stay until their words are known.
    top = settle(best.withColumn("place", F.rank().over(
        Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= first).drop("place"),
        "best-phrases")
    spelt = top.select("k", F.posexplode("k").alias("at", "h")).join(
        known.select("h", "word"), "h").groupBy("k").agg(F.array_join(F.transform(F.array_sort(
            F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = top.join(spelt, "k").withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= first).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
