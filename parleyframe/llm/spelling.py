"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

An edit moves a word's vector of letter counts by at most two in L1 distance
(one for an insertion), so the near words of a word lie in a small box around
its vector.  The words of each length stand in a k-d tree; its upper levels,
grown on a bounded sample, are the cells that Spark deals words to.  A word asks
the cells of its own length within distance two (one letter replaced) and those
of the next length within one (one letter inserted); in a cell a tree of its
points is searched with the same pruning, and the order of letters is verified.
A cell with too many points or questions is dealt out over several tasks.

A null text has no words; a null id counts as empty text before the colon.
Rows that repeat an id and a text count as often as they stand.  Ties between
near words of equal counts go to the smallest in code-point order.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text
from parleyframe.sources.tables import settle

#: The letters, the shortest word, the fewest occurrences, and how
#: many times as frequent a word's form is.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, TIMES = 6, 5, 5
#: Every so many occurrences (by checksum) lose a letter.
DAMAGED = 199
#: Distinct runs a counting task holds before it passes them on.
HELD = 500_000
#: Words a cell is meant to hold, sampled words a cell, cells of one length at most.
CELL, SAMPLED, CELLS = 16_000, 64, 1024
#: What one search takes at most; more is dealt out.
POINTS, QUESTIONS = 32_000, 200_000
_LEAF, _PAIRS = 16, 1_000_000

# One number for every letter, by code point.
_NUMBER = np.full(256, -1, np.int64)
_NUMBER[ord("a"):ord("z") + 1] = range(26)
_NUMBER[0xC0:] = range(26, 26 + 64)
_KINDS = 26 + 64


# ------------------------------------------------------------------ words

def _damaged(word, prefix, every):
    at = zlib.crc32(word.encode(), prefix)
    if at % every:
        return word
    at %= len(word)
    return word[:at] + word[at + 1:]


def count_words(docs, id_column="doc_id", text_column="text", shortest=SHORTEST, every=DAMAGED):
    """(word, n): the words of at least ``shortest`` letters and their occurrences."""
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def counted(held):
        return pa.record_batch({
            "word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def count(batches):
        held = {}
        for batch in batches:
            for name, text in zip(batch["id"], batch["text"]):
                here = {}
                for word in run.findall(text.as_py().encode().lower().decode()):
                    here[word] = here.get(word, 0) + 1
                prefix = zlib.crc32(f"{name.as_py()}:".encode())
                for word, n in here.items():
                    word = _damaged(word, prefix, every)
                    if len(word) >= shortest:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield counted(held)
                    held = {}
        if held:
            yield counted(held)

    texts = id_and_text(docs, id_column, text_column).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n"))


# ------------------------------------------------------------------ trees

def _codes(words, size):
    """A row of code points for each word."""
    return np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size)


def letter_counts(codes):
    """How often each letter stands in each word."""
    rows = np.repeat(np.arange(len(codes)), codes.shape[1]) * _KINDS
    return np.bincount(rows + _NUMBER[codes].ravel(), minlength=len(codes) * _KINDS).reshape(
        len(codes), _KINDS).astype(np.int32)


def grow(counts, leaf):
    """A k-d tree as a list of nodes (letter, largest count on the left, left, right);
    a leaf is (None, its points).  Equal vectors are never parted."""
    nodes, open_ = [None], [(0, np.arange(len(counts)))]
    while open_:
        at, points = open_.pop()
        here = counts[points]
        spread = here.var(axis=0) if len(points) > leaf else np.zeros(1)
        letter = int(spread.argmax())
        if not spread[letter] > 0:
            nodes[at] = (None, points)
            continue
        values = here[:, letter]
        most = min(int(np.median(values)), int(values.max()) - 1)
        nodes[at] = (letter, most, len(nodes), len(nodes) + 1)
        open_ += [(len(nodes), points[values <= most]), (len(nodes) + 1, points[values > most])]
        nodes += [None, None]
    return nodes


def reached(tree, counts, budget):
    """(leaf node, rows of ``counts``) for every leaf whose box is within ``budget``
    (a number for each row) of them."""
    everything = np.arange(len(counts))
    open_ = [(0, everything, np.zeros(len(counts), np.int64), {})]
    while open_:
        at, rows, far, box = open_.pop()
        node = tree[at]
        if node[0] is None:
            yield at, rows
            continue
        letter, most, left, right = node
        low, high = box.get(letter, (0, np.iinfo(np.int32).max))
        values = counts[rows, letter]
        inside = far - np.maximum(0, np.maximum(low - values, values - high))
        for child, a, b in ((left, low, most), (right, most + 1, high)):
            there = inside + np.maximum(0, np.maximum(a - values, values - b))
            near = there <= budget[rows]
            if near.any():
                open_.append((child, rows[near], there[near], {**box, letter: (a, b)}))


# ------------------------------------------------------------------ search in a cell

def _sketch(counts):
    """64 bits; an edit changes no more of them than it moves the vector."""
    bits = [counts[:, :26] > 0, counts[:, :26] > 1]
    rest = np.stack([counts[:, 26 + i::12].sum(axis=1) for i in range(12)], axis=1)
    bits = np.concatenate([*bits, rest > 0], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def _one_edit(a, b):
    """Whether rows of code points differ by one replaced or inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    size = a.shape[1]
    differ = a != b[:, :-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    shifted = (a != b[:, 1:])[:, ::-1]
    last = np.where(shifted.any(axis=1), size - shifted.argmax(axis=1), 0)
    return first >= last


def _best(target, n, rank):
    """Of each target: its number of rows, and the row of largest n, then smallest rank."""
    order = np.lexsort((rank, -n, target))
    starts = np.flatnonzero(np.diff(target[order], prepend=-1))
    return target[order][starts], np.diff(np.append(starts, len(order))), order[starts]


def _search(rows: pa.Table) -> pa.Table:
    size, is_point = rows["size"][0].as_py(), rows["point"].to_numpy()
    words = np.array(rows["word"].to_pylist(), dtype=object)
    n = rows["n"].to_numpy()
    points = np.flatnonzero(is_point)
    found = []
    if len(points):
        codes = _codes(words[points], size)
        counts = letter_counts(codes)
        tree, sketch = grow(counts, _LEAF), _sketch(counts)
        length = rows["length"].to_numpy()
        for asking, budget in ((size, 2), (size - 1, 1)):
            asked = np.flatnonzero(~is_point & (length == asking))
            if len(asked):
                own = _codes(words[asked], asking)
                for a, b in _pairs(tree, sketch, codes, own, budget):
                    found.append((asked[a], points[b]))
                    if budget == 1:
                        found.append((points[b], asked[a]))
    target, other = (np.concatenate([pair[i] for pair in found]) if found
                     else np.array([], np.int64) for i in range(2))
    distinct, rank = np.unique(words[other].astype(str), return_inverse=True)
    target, count, best = _best(target, n[other], rank)
    return pa.table({
        "word": pa.array(words[target], pa.string()), "n_near": pa.array(count, pa.int64()),
        "best_n": pa.array(n[other][best], pa.int64()),
        "best": pa.array(words[other][best], pa.string())})


def _pairs(tree, sketch, codes, own, budget):
    """(question, point) rows that are one edit apart."""
    counts = letter_counts(own)
    asking = _sketch(counts)
    held, size = [], 0

    def verified():
        a, b = (np.concatenate([pair[i] for pair in held]) for i in range(2))
        near = _one_edit(own[a], codes[b])
        return a[near], b[near]

    for leaf, rows in reached(tree, counts, np.full(len(own), budget)):
        inside = tree[leaf][1]
        at_once = max(1, _PAIRS // len(inside))
        for begin in range(0, len(rows), at_once):
            some = rows[begin:begin + at_once]
            close = np.bitwise_count(
                asking[some][:, None] ^ sketch[inside][None, :]) <= budget
            a, b = np.nonzero(close)
            held.append((some[a], inside[b]))
            size += len(a)
            if size > _PAIRS:
                yield verified()
                held, size = [], 0
    if held:
        yield verified()


# ------------------------------------------------------------------ all words

def _trees(words):
    """A tree of cells for every length, grown on a bounded sample of its words."""
    sizes = {row["length"]: row["n"] for row in words.groupBy("length").agg(
        F.count("*").alias("n")).collect()}
    cells = {size: min(CELLS, -(-n // CELL)) for size, n in sizes.items()}
    # Of every length with more than one cell, each ``step``-th word by hash.
    steps = {size: max(1, sizes[size] // (SAMPLED * cells[size]))
             for size in cells if cells[size] > 1}
    sampled = {}
    if steps:
        step = F.create_map(*(F.lit(x) for pair in steps.items() for x in pair))[F.col("length")]
        for row in words.where(F.pmod(F.xxhash64("word"), step) == 0).select(
                "length", "word").collect():
            sampled.setdefault(row["length"], []).append(row["word"])
    trees = {}
    for size in sizes:
        sample = sampled.get(size, [])
        counts = letter_counts(_codes(sample, size))
        tree = grow(counts, max(1, -(-len(sample) // cells[size])))
        trees[size] = [(None, None) if node[0] is None else node for node in tree]
    return trees


def _routed(words, trees):
    """Every word as a point of its cell and as a question to the cells in reach."""
    def route(batches):
        for batch in batches:
            length = batch["length"].to_numpy()
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                counts = letter_counts(_codes(batch["word"].take(pa.array(rows)).to_pylist(), size))
                for to, point, budget in ((size, True, 0), (size, False, 2), (size + 1, False, 1)):
                    for cell, some in (
                            reached(trees[to], counts, np.full(len(rows), budget))
                            if to in trees else ()):
                        part = batch.take(pa.array(rows[some]))
                        n = part.num_rows
                        yield pa.record_batch({
                            "size": pa.array([to] * n, pa.int32()),
                            "cell": pa.array([cell] * n, pa.int32()),
                            "point": pa.array([point] * n, pa.bool_()),
                            **{name: part[name] for name in ("length", "word", "n")}})

    return words.mapInArrow(
        route, "size int, cell int, point boolean, length int, word string, n bigint")


def near_words(words):
    """(word, n_near, best_n, best): how many of ``words`` (word, n, length) are one
    edit away, and the most frequent of them."""
    routed = settle(_routed(words, _trees(words)), "routed-words")
    crowd = settle(routed.groupBy("size", "cell").agg(
        F.ceil(F.count_if("point") / POINTS).cast("int").alias("parts"),
        F.ceil(F.count_if(~F.col("point")) / QUESTIONS).cast("int").alias("shares")), "crowd")

    def dealt(many, of_all):
        own = F.array(F.pmod(F.xxhash64("word"), F.greatest(F.col(many), F.lit(1))).cast("int"))
        every = F.sequence(F.lit(0), F.greatest(F.col(many), F.lit(1)) - 1)
        return F.explode(F.when(of_all, every).otherwise(own))

    tasks = routed.join(crowd.where("parts > 0"), ["size", "cell"]).withColumn(
        "part", dealt("parts", ~F.col("point"))).withColumn("share", dealt("shares", F.col("point")))
    near = tasks.groupBy("size", "cell", "part", "share").applyInArrow(
        _search, "word string, n_near bigint, best_n bigint, best string")
    return near.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    ).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _roots(forms):
    """``forms`` (word, form or null, ...) with ``root``, by doubling steps: a form is
    ``TIMES`` as frequent, so chains are short."""
    links = settle(forms.where("form is not null").select("word", F.col("form").alias("root")),
                   "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = settle(links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return forms.join(links.select("word", "root"), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))


def variants(docs, id_column="doc_id", text_column="text", least=LEAST, times=TIMES):
    """word, form, root, n, n_near, form_n of every word with ``least`` occurrences."""
    words = settle(count_words(docs, id_column, text_column).where(F.col("n") >= least).select(
        "word", "n", F.length("word").alias("length")), "words")
    is_form = F.col("best_n") >= times * F.col("n")
    forms = settle(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "word-forms")
    return _roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
