"""Best-fit packing of token pieces into sequences of ``CAPACITY`` tokens.

A text's token ids and one end id are cut into pieces of at most ``CAPACITY``
tokens; only longer ones are cut.  Pieces and gaps have whole sizes up to
``CAPACITY``, so sorted by size each is a few thousand runs of equal members,
however many there are.  Packing goes in rounds over these runs: every size of
piece sweeps, from large to small, to its successor, the smallest gap that holds
it; where several want a gap the one of higher rank (larger, then earlier) has
it; the gaps are updated when the round is over, so that a gap takes one piece a
round.  Pieces of more than a half open sequences, then those of more than a
third sweep, and open what they still need, and so on.  Spark numbers the pieces
of each size and places every piece by its number, independent of all others.

Null text counts as empty: one piece of the end id.  Rows that repeat an id and
a text are packed once each.  An empty table gives no pieces.
"""

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text, map_batches, text_key
from parleyframe.sources.tables import settle

CAPACITY = 4096
END = 1
#: Words a worker remembers; beyond them it forgets those that the texts at hand lack.
REMEMBERED_WORDS = 300_000
#: Marks after a word's letters, read apart from these; an apostrophe may belong to them.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

# Control characters, wide blanks and letters past Latin: the library reads these texts whole.
_UNUSUAL = re.compile(r"[^\x09-\x0D\x20-\x7E\xA1-\u024F]")
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders = {}


class WordEncoder:
    """Ids the library gives for whole texts, as little-endian 32-bit bytes.

    The vocabulary ends every word with a mark and drops blanks, so words are
    encoded apart, once each while remembered.
    """

    def __init__(self, file):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.whole = Tokenizer.from_str(file)
        spec = json.loads(file)
        mark = spec["model"].get("end_of_word_suffix")
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_word = bool(mark) and kinds == ["NFC", "Replace", "Lowercase"] and (
            json.dumps(_PARTS) in json.dumps(spec["pre_tokenizer"]))
        self.words, self.ends = {}, {}
        if self.by_word:
            self.letters = Tokenizer.from_str(file)
            self.letters.normalizer = normalizers.Sequence([])
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.whole.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            for token, number in vocabulary.items():
                self.last[number] = token.endswith(mark)

    def _ids(self, texts):
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _letter_words(self, words):
        """Ids of words of letters, read as one text and parted at the word ends."""
        ids = np.array(self.letters.encode_batch_fast(
            [" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(words):
            return self._ids(words)
        data = ids.tobytes()
        return [data[4 * a:4 * b] for a, b in zip([0, *ends], ends)]

    def _learn(self, words):
        """Remember words, those of letters with marks after them in two parts."""
        known, letters, marked, others = self.words, set(), [], []
        for word in words:
            if word.isalpha():
                letters.add(word)
                continue
            stem = word.rstrip(_MARKS)
            if stem.isalpha():
                marked.append((word, stem))
                if stem not in known:
                    letters.add(stem)
            else:
                others.append(word)
        if letters:
            letters = list(letters)
            known.update(zip(letters, self._letter_words(letters)))
        if others:
            known.update(zip(others, self._ids(others)))
        if len(self.ends) > REMEMBERED_WORDS:
            self.ends = {}
        for word, stem in marked:
            end = word[len(stem):]
            if end not in self.ends:
                self.ends[end] = self._ids([end])[0]
            known[word] = known[stem] + self.ends[end]

    def __call__(self, texts):
        out, split = [None] * len(texts), {}
        for i, text in enumerate(texts):
            if self.by_word and "<|" not in text and not _UNUSUAL.search(text):
                split[i] = text.lower().split()
            else:
                out[i] = self._ids([text])[0]
        met = set().union(*split.values())
        if len(self.words) > REMEMBERED_WORDS:
            self.words = {word: self.words[word] for word in met & self.words.keys()}
        self._learn(met.difference(self.words))
        ids = self.words.__getitem__
        for i, words in split.items():
            out[i] = b"".join(map(ids, words))
        return out


def _encoder(file):
    key = hash(file)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(file)
    return _encoders[key]


def pieces(docs, tokenizer_path, capacity=CAPACITY, id_column="doc_id", text_column="text",
           batch_texts=250):
    """doc_id, key (of the text), piece, start, length and ids_crc32 of every piece."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([END], "<u4").tobytes()

    def run(batch):
        encoder, rows, columns = _encoder(shipped.value), [], ([], [], [], [])
        for at in range(0, batch.num_rows, batch_texts):
            texts = batch["text"].slice(at, batch_texts).to_pylist()
            for row, ids in enumerate(encoder(texts), at):
                ids += end
                for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    rows.append(row)
                    for column, value in zip(
                            columns, (number, start // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
        rows = pa.array(rows, pa.int64())
        return pa.table({
            "doc_id": batch["doc_id"].take(rows), "key": batch["key"].take(rows),
            "piece": pa.array(columns[0], pa.int32()), "start": pa.array(columns[1], pa.int64()),
            "length": pa.array(columns[2], pa.int64()),
            "ids_crc32": pa.array(columns[3], pa.int64())})

    texts = id_and_text(docs, id_column, text_column).withColumn("key", text_key(F.col("text")))
    kinds = dict(texts.dtypes)
    return map_batches(
        texts, run, f"doc_id {kinds['doc_id']}, key {kinds['key']}, piece int, start bigint, "
        "length bigint, ids_crc32 bigint")


class Rounds:
    """Sequences under way: gaps by size, and where the members of each size go."""

    def __init__(self, counts, capacity=CAPACITY):
        self.capacity = capacity
        self.waiting = dict(counts)
        self.placed = dict.fromkeys(counts, 0)
        self.gaps = {}
        self.opened = 0
        #: (size, first member, first sequence, offset), each as long as the next begins.
        self.runs = []

    def _place(self, size, first_sequence, offset, count):
        self.runs.append((size, self.placed[size], first_sequence, offset))
        self.placed[size] += count
        self.waiting[size] -= count

    def open(self, size, count):
        """The next members of a size begin sequences of their own."""
        self._place(size, self.opened, 0, count)
        self.gaps.setdefault(self.capacity - size, []).append((self.opened, count))
        self.opened += count

    def sweep(self, sizes):
        """One round: larger sizes first, each to its successors; True if any moved."""
        left, free = {}, sorted(g for g, runs in self.gaps.items() if g and runs)
        for size in sizes:
            while self.waiting[size]:
                at = np.searchsorted(free, size)
                if at == len(free):
                    break
                gap = free[at]
                first, count = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    free.pop(at)
                used = min(count, self.waiting[size])
                self._place(size, first, self.capacity - gap, used)
                left.setdefault(gap - size, []).append((first, used))
                if used < count:
                    if not self.gaps[gap]:
                        free.insert(at, gap)
                    self.gaps[gap].append((first + used, count - used))
        for gap, runs in left.items():
            self.gaps.setdefault(gap, []).extend(runs)
        return bool(left)

    def run(self):
        sizes = sorted((s for s, n in self.waiting.items() if n), reverse=True)
        part = 1
        while sizes:
            # Pieces of which ``part``, but no more, fit in a sequence; the smallest together.
            band = [s for s in sizes if part >= 8 or s * (part + 1) > self.capacity]
            sizes = sizes[len(band):]
            while any(self.waiting[s] for s in band):
                while part > 1 and self.sweep(band):
                    pass
                members = sum(self.waiting[s] for s in band)
                tokens = sum(self.waiting[s] * s for s in band)
                need = -(-members // part) if part < 8 else -(-tokens // self.capacity)
                for size in band:
                    count = min(need, self.waiting[size])
                    if count:
                        self.open(size, count)
                        need -= count
            part += 1
        return self.runs


def _ranked(table, salts):
    """``rank`` of every piece among those of its length; no length is gathered."""
    salted = table.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt"))
                           - F.col("n")).alias("before"))
    own = F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "key", "piece"))
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.col("own") - 1)


def pack(docs, tokenizer_path, capacity=CAPACITY, id_column="doc_id", text_column="text"):
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    table = settle(pieces(docs, tokenizer_path, capacity, id_column, text_column), "pieces")
    # At most ``capacity`` sizes, whatever the number of pieces.
    counts = {row[0]: row[1] for row in table.groupBy("length").count().collect()}
    runs = np.array(sorted(Rounds(counts, capacity).run()), np.int64).reshape(-1, 4)
    plan = spark.sparkContext.broadcast(runs)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(batch):
        size, first, sequence, offset = plan.value.T
        length = np.asarray(batch["length"]).astype(np.int64)
        rank = np.asarray(batch["rank"]).astype(np.int64)
        lows = np.searchsorted(size, np.arange(capacity + 2))
        run = np.empty(len(length), np.int64)
        for s in np.unique(length):
            mine = length == s
            low, high = lows[s], lows[s + 1]
            run[mine] = low + np.searchsorted(first[low:high], rank[mine], side="right") - 1
        return pa.Table.from_batches([batch]).select(
            ["doc_id", "piece", "start", "length", "ids_crc32"]).append_column(
            "sequence_id", pa.array(sequence[run] + rank - first[run])).append_column(
            "offset", pa.array(offset[run]))

    kind = dict(table.dtypes)["doc_id"]
    return map_batches(
        _ranked(table, salts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank"),
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint")
