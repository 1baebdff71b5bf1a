"""Removal of repeated passages by Rabin-Karp hashes of every word window.

Each window of ``width`` words gets a polynomial hash from running sums.  A map
task takes a unit of up to ``UNIT_WORDS`` words, keeps for each distinct hash
its first place in the unit, and sends the hashes to buckets as packed arrays:
a window that fills a third of the corpus is one entry a unit.  A bucket finds
the first place of each hash among its units and reports the later ones back to
their units, where the reports of all buckets merge into intervals of words.

The first place of a window is the one with the smallest (id, start); every
later one is removed, places that tie are kept.  A null id counts as the
smallest id.  Null text has no words; a text shorter than a window loses
nothing.  Rows that repeat an id and a text are one document, answered per row.
Two windows count as equal when 64 bits of hash and their bucket agree.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text, map_batches, text_key

WIDTH = 20
#: Words whose hashes a map task holds at once; longer texts are read in segments.
UNIT_WORDS = 2_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses
_NO_ID = -(1 << 63)

MESSAGE = "bucket bigint, unit binary, kind int, payload binary"
BLOB, UNIT, LATER = range(3)


def _mixed(x):
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(words, width, base):
    """Polynomial hash of every window of ``words`` (uint64), modulo 2**64."""
    n = len(words)
    inverse = pow(base, -1, 1 << 64)
    powers = np.ones(n, np.uint64)
    powers[1:] = np.uint64(base)
    np.multiply.accumulate(powers, out=powers)
    back = np.ones(n - width + 1, np.uint64)
    back[1:] = np.uint64(inverse)
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
    return (sums[width:] - sums[:-width]) * back


def _pack(*arrays):
    """Arrays in one byte string; small numbers shrink."""
    parts = [np.array([len(arrays), *(
        x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64).tobytes()]
    return b"".join(parts + [np.ascontiguousarray(a).tobytes() for a in arrays])


def _unpack(data, kinds):
    count = int(np.frombuffer(data, np.int64, 1)[0])
    heads = np.frombuffer(data, np.int64, 2 * count, 8).reshape(-1, 2)
    at, arrays = 8 + 16 * count, []
    for (_, length), kind in zip(heads, kinds):
        arrays.append(np.frombuffer(data, kind, length, at))
        at += int(length) * np.dtype(kind).itemsize
    return arrays


def _steps(ascending):
    """Ascending places as differences, low and high bytes apart."""
    steps = np.diff(ascending, prepend=0).astype("<u4")
    planes = steps.view(np.uint8).reshape(-1, 4)
    return planes[:, 0], planes[:, 1], zlib.compress(planes[:, 2:].tobytes(), 1)


def _places(low, high, rest):
    planes = np.zeros((len(low), 4), np.uint8)
    planes[:, 0], planes[:, 1] = low, high
    planes[:, 2:] = np.frombuffer(zlib.decompress(rest.tobytes()), np.uint8).reshape(-1, 2)
    return np.cumsum(planes.view("<u4").ravel().astype(np.int64))


def _bytes(data):
    return np.frombuffer(data, np.uint8)


def _later(hashes, order_key):
    """Indexes of all first and of all later entries among equal hashes."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    firsts = np.minimum.reduceat(order_key[order], heads)
    size = np.diff(np.append(heads, len(order)))
    later = np.zeros(len(order), bool)
    later[order] = order_key[order] > np.repeat(firsts, size)
    return later


class _Unit:
    """Segments of documents read together."""

    def __init__(self):
        self.segments, self.words, self.size = [], [], 0

    def add(self, doc_id, key, start, words):
        self.segments.append((doc_id, key[0], key[1], start, len(words)))
        self.words.append(words)
        self.size += len(words)

    def messages(self, width, buckets):
        order = sorted(range(len(self.segments)), key=lambda i: self.segments[i])
        segments = np.array([self.segments[i] for i in order], np.int64).reshape(-1, 5)
        words = np.concatenate([self.words[i] for i in order])
        if len(words) < width:
            return
        lengths = segments[:, 4]
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        # A window stays in its segment.
        room = np.repeat(offsets + lengths, lengths) - np.arange(len(words))
        places = np.flatnonzero(room >= width)
        if not len(places):
            return
        hashes = _mixed(window_hashes(words, width, _BASES[0])[places])
        extra = _mixed(window_hashes(words, width, _BASES[1])[places])
        owner = np.repeat(np.arange(len(segments)), lengths)[places]
        starts = places - offsets[owner] + segments[owner, 3]
        _, rank = np.unique(segments[:, 0], return_inverse=True)
        later = _later(hashes, (rank[owner] << 33) + starts)
        unit = hashlib.blake2b(segments.tobytes(), digest_size=16).digest()
        yield (-1 - int.from_bytes(unit[:4], "little") % buckets, unit, UNIT, _pack(
            segments.ravel(), places[later].astype(np.uint32)))
        first = ~later
        places, owner, hashes = places[first], owner[first], hashes[first]
        bucket = (extra[first] >> np.uint64(20)) % np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            mine = by[edges[b]:edges[b + 1]]
            if len(mine):
                present, held = np.unique(owner[mine], return_counts=True)
                about = zlib.compress(_pack(
                    segments[present, 0], segments[present, 3] - offsets[present], held), 1)
                low, high, rest = _steps(places[mine])
                yield b, unit, BLOB, _pack(
                    hashes[mine], low, high, _bytes(rest), _bytes(about))


def _digest_words(words):
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _table(rows, schema):
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema)


_MESSAGES = pa.schema([("bucket", pa.int64()), ("unit", pa.binary()), ("kind", pa.int32()),
                       ("payload", pa.binary())])


def _emit(width, buckets, unit_words):
    def run(batches):
        unit = _Unit()
        for batch in batches:
            ids, a, b = (batch[i].to_pylist() for i in (0, 1, 2))
            for row, value in enumerate(batch[3]):
                words = value.as_py().encode().split()
                doc_id = _NO_ID if ids[row] is None else ids[row]
                for start in range(0, max(len(words) - width, 0) + 1, unit_words):
                    # A segment reads on far enough for windows that begin in it.
                    segment = words[start:start + unit_words + width - 1]
                    if len(segment) >= width:
                        unit.add(doc_id, (a[row], b[row]), start, _digest_words(segment))
                    if unit.size >= unit_words:
                        for message in unit.messages(width, buckets):
                            yield _table([message], _MESSAGES).to_batches()[0]
                        unit = _Unit()
        if unit.size:
            for message in unit.messages(width, buckets):
                yield _table([message], _MESSAGES).to_batches()[0]
    return run


def _judge(table):
    """One bucket: entries that are not the first of their hash go back to their units."""
    units = table["unit"].to_pylist()
    if table["kind"][0].as_py() == UNIT:
        return table.select(["unit", "kind", "payload"])
    hashes, ids, starts, places = [], [], [], []
    for payload in table["payload"]:
        own, low, high, rest, about = _unpack(
            payload.as_buffer(), ["<u8", np.uint8, np.uint8, np.uint8, np.uint8])
        doc_ids, shift, held = _unpack(
            zlib.decompress(about.tobytes()), [np.int64, np.int64, np.int64])
        place = _places(low, high, rest)
        hashes.append(own)
        places.append(place)
        ids.append(np.repeat(doc_ids, held))
        starts.append(place + np.repeat(shift, held))
    sizes = [len(x) for x in hashes]
    hashes, ids, starts = map(np.concatenate, (hashes, ids, starts))
    # Only hashes met more than once need an order.
    order = np.argsort(hashes)
    equal = hashes[order][1:] == hashes[order][:-1]
    again = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
    chosen = order[again]
    later = np.zeros(len(hashes), bool)
    if len(chosen):
        _, rank = np.unique(ids[chosen], return_inverse=True)
        later[chosen] = _later(hashes[chosen], (rank << 33) + starts[chosen])
    edges = np.cumsum([0, *sizes])
    rows = []
    for i, place in enumerate(places):
        found = place[later[edges[i]:edges[i + 1]]]
        if len(found):
            low, high, rest = _steps(found)
            rows.append((units[i], LATER, _pack(low, high, _bytes(rest))))
    return _table(rows, pa.schema(list(_MESSAGES)[1:]))


def _merge(width):
    """One unit: all its later windows as intervals of words, per document."""
    def run(table):
        segments, later = None, []
        for kind, payload in zip(table["kind"].to_pylist(), table["payload"]):
            if kind == UNIT:
                segments, own = _unpack(payload.as_buffer(), [np.int64, np.uint32])
                later.append(own.astype(np.int64))
            else:
                later.append(_places(*_unpack(payload.as_buffer(), [np.uint8] * 3)))
        segments = segments.reshape(-1, 5)
        places = np.unique(np.concatenate(later))
        offsets = np.concatenate([[0], np.cumsum(segments[:, 4])])
        cuts = np.searchsorted(places, offsets)
        rows = []
        for i in np.flatnonzero(np.diff(cuts)):
            doc_id, a, b, start, _ = segments[i].tolist()
            begins = places[cuts[i]:cuts[i + 1]] - offsets[i] + start
            heads = np.flatnonzero(np.concatenate([[True], np.diff(begins) > width]))
            tails = np.append(heads[1:], len(begins)) - 1
            rows.append((
                None if doc_id == _NO_ID else doc_id, a, b,
                np.column_stack([begins[heads], begins[tails] + width]).ravel().tolist()))
        return _table(rows, pa.schema([
            ("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
            ("cut", pa.list_(pa.int64()))]))
    return run


def repeated_intervals(docs, width=WIDTH, id_column="doc_id", text_column="text", buckets=None,
                       unit_words=UNIT_WORDS):
    """id, a, b (text key) and ``cuts``: arrays of begin, end, begin, end ... in
    words, of the documents with windows that also start earlier."""
    spark = docs.sparkSession
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = id_and_text(docs, id_column, text_column).withColumn("key", text_key(F.col("text")))
    sent = texts.select(
        F.col("doc_id").cast("bigint").alias("id"), "key.a", "key.b", "text").mapInArrow(
        _emit(width, buckets, unit_words), MESSAGE)
    judged = sent.groupBy("bucket").applyInArrow(_judge, "unit binary, kind int, payload binary")
    merged = judged.groupBy("unit").applyInArrow(
        _merge(width), "id bigint, a bigint, b bigint, cut array<bigint>")
    return merged.groupBy("id", "a", "b").agg(F.collect_list("cut").alias("cuts"))


def _union(cuts):
    """Merged, ascending intervals."""
    merged = []
    for cut in cuts or ():
        merged += zip(cut[::2], cut[1::2])
    out = []
    for begin, end in sorted(merged):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([begin, end])
    return out


def deduplicate(docs, width=WIDTH, id_column="doc_id", text_column="text", **options):
    """doc_id, n_words, n_removed and ``kept``: the words that stay, joined by blanks."""
    cuts = repeated_intervals(docs, width, id_column, text_column, **options)
    texts = id_and_text(docs, id_column, text_column).withColumn("key", text_key(F.col("text")))
    joined = texts.join(
        cuts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key.a") == F.col("a"))
        & (F.col("key.b") == F.col("b")), "left").select("doc_id", "text", "cuts")

    def cut(batch):
        totals, removed, kept = [], [], []
        for text, cuts in zip(batch["text"], batch["cuts"]):
            words = text.as_py().encode().split()
            left, at, gone = [], 0, 0
            for begin, end in _union(cuts.as_py()):
                left += words[at:begin]
                at, gone = end, gone + end - begin
            left += words[at:]
            totals.append(len(words))
            removed.append(gone)
            kept.append(b" ".join(left))
        return pa.table({"doc_id": batch["doc_id"], "n_words": pa.array(totals, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return map_batches(
        joined, cut, f"doc_id {dict(texts.dtypes)['doc_id']}, n_words bigint, n_removed bigint, "
        "kept string")
