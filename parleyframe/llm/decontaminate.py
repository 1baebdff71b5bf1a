"""Benchmark decontamination with a suffix automaton over the test items.

The automaton accepts every word sequence that occurs inside an item.  A
document is streamed through it once; after each word it gives the length of
the longest suffix read so far that occurs in some item.  Where that length
reaches the limit (or a whole shorter item ends), the matched words are hit.

Null and empty texts have no words and are never contaminated; items without
words match nothing.  Repeated rows are judged alike, each on its own.  An item
id may repeat or be null (a null id is shown as an empty string).
"""

import re
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from parleyframe.llm.common import column_of, id_and_text, packed, with_fields

#: Item words in one automaton, which takes some hundred bytes for each.
SHARD_WORDS = 100_000

# Lower-case letters and digits stay, all other ASCII parts words.
_WORDS = bytes(
    c if c >= 0x80 or chr(c).isalnum() and not 0x41 <= c <= 0x5A
    else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD_PLACES = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    """Lower-case words, UTF-8 encoded."""
    return text.encode().translate(_WORDS).split()


class Matcher:
    """Suffix automaton of all items, one after another from the root."""

    def __init__(self, items, window=10):
        self.window = window
        self.words = {}
        self.moves, self.link, self.length = [{}], [-1], [0]
        ends, sequences = [], []
        for _, text in items:
            sequence = [self.words.setdefault(w, len(self.words)) for w in words_of(text)]
            last = 0
            for word in sequence:
                last = self._extend(last, word)
            sequences.append(sequence)
            ends.append(last)
        # The longest whole short item that ends in a state or in one of its suffixes.
        self.short = [0] * len(self.length)
        self.holders = {}
        for (item, _), sequence, end in zip(items, sequences, ends):
            if 0 < len(sequence) < window:
                self.short[end] = len(sequence)
                self.holders.setdefault((end, len(sequence)), set()).add(item)
            for state, matched in self._walk(sequence):
                if matched >= window:
                    self.holders.setdefault((self._suffix(state), window), set()).add(item)
        self.shorts_below = [0] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            above = self.link[state]
            self.shorts_below[state] = self.shorts_below[above] or int(self.short[above] > 0)
        self.any_short = [
            a or b > 0 for a, b in zip(self.shorts_below, self.short)]

    def _state(self, moves, link, length):
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last, word):
        """The state of the item read so far and this word."""
        moves, link, length = self.moves, self.link, self.length
        known = moves[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state({}, 0, length[last] + 1)
        at = last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = new
            at = link[at]
        if at >= 0:
            target = moves[at][word]
            link[new] = (
                target if length[target] == length[at] + 1 else self._split(at, word, target))
        return new

    def _split(self, at, word, target):
        moves, link = self.moves, self.link
        copy = self._state(dict(moves[target]), link[target], self.length[at] + 1)
        link[target] = copy
        while at >= 0 and moves[at].get(word) == target:
            moves[at][word] = copy
            at = link[at]
        return copy

    def _suffix(self, state):
        """The state of the last ``window`` words of a match at least that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _walk(self, sequence):
        """State and longest match length after each word."""
        moves, link, length = self.moves, self.link, self.length
        state = matched = 0
        for word in sequence:
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            following = moves[state].get(word)
            if following is not None:
                state = following
                matched += 1
            yield state, matched

    def __call__(self, words):
        """Hit intervals of word positions, merged, and the items they come from."""
        moves, link, length = self.moves, self.link, self.length
        root, window, any_short = moves[0], self.window, self.any_short
        codes = map(self.words.get, words)
        found, items = [], set()
        state = matched = 0
        for place, word in enumerate(codes, 1):
            here = moves[state]
            if word in here:
                state = here[word]
                matched += 1
            else:
                if word is None:
                    state = matched = 0
                    continue
                while state:
                    state = link[state]
                    if word in moves[state]:
                        matched = length[state] + 1
                        state = moves[state][word]
                        break
                else:
                    state = root.get(word, 0)
                    matched = 1 if state else 0
                    # The root has no link to follow.
            if matched >= window:
                reach = window
                items |= self.holders[self._suffix(state), window]
            elif any_short[state]:
                reach = 0
            else:
                continue
            if any_short[state]:
                reach = max(reach, self._shorts(state, matched, items))
            if reach:
                begin = place - reach
                while found and found[-1][1] >= begin:
                    begin = min(begin, found.pop()[0])
                found.append((begin, place))
        return found, items

    def _shorts(self, state, matched, items):
        """Longest whole short item that ends here; adds all that do to ``items``."""
        longest = 0
        if self.short[state] and matched < self.length[state]:
            state = self.link[state]
        while state > 0:
            if self.short[state]:
                longest = max(longest, self.short[state])
                items |= self.holders[state, self.short[state]]
            if not self.shorts_below[state]:
                break
            state = self.link[state]
        return longest


def item_shards(items, item_column="item_id", text_column="text", shard_words=SHARD_WORDS):
    """Lists of (id, text) of about ``shard_words`` words at most, one at a time.

    Several shards are dealt by hash, half full on average, and only one is on
    the driver at a time.
    """
    chosen = items.select(
        F.coalesce(items[item_column].cast("string"), F.lit("")).alias("item"),
        F.coalesce(items[text_column], F.lit("")).alias("text"))
    n_words = F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    total = chosen.agg(F.sum(n_words)).first()[0] or 0
    shards = -(-total // shard_words)
    if shards <= 1:
        yield [tuple(row) for row in chosen.collect()]
        return
    dealt = chosen.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(2 * shards)))
    for shard in range(2 * shards):
        part = [tuple(row) for row in dealt.where(F.col("shard") == shard).drop("shard").collect()]
        if part:
            yield part


def _merged(intervals):
    out = []
    for begin, end in sorted(intervals):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


# Automata a worker has built; one is kept at a time.
_built = {}


def _matcher(key, shard, window):
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(shard.value, window)
    return _built[key]


def with_hits(docs, items, window=10, item_column="item_id", item_text="text",
              shard_words=SHARD_WORDS, text_column="text"):
    """All columns of ``docs`` in the struct ``row``, with ``n_words``, ``hits``
    (merged [begin, end) word intervals), ``items`` (ids with matches) and ``cut``
    (the text without what is hit; null where nothing is).

    The automaton of a shard of items is broadcast (``shard_words`` bounds it);
    with several shards each batch of documents passes through one after another.
    """
    spark = docs.sparkSession
    shards = [
        spark.sparkContext.broadcast(shard)
        for shard in item_shards(items, item_column, item_text, shard_words)]
    run_id = uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            texts, n = column_of(batch, text_column), batch.num_rows
            counts, found, names = [0] * n, [[] for _ in range(n)], [set() for _ in range(n)]
            for number, shard in enumerate(shards):
                matcher = _matcher((run_id, number), shard, window)
                for i, text in enumerate(texts):
                    words = words_of(text.as_py() or "")
                    counts[i] = len(words)
                    spans, matched = matcher(words)
                    if spans:
                        found[i] += spans
                        names[i] |= matched
            hits = [_merged(x) for x in found]
            cut = [_cut(texts[i].as_py(), hits[i]) if hits[i] else None for i in range(n)]
            yield pa.RecordBatch.from_arrays([
                batch["row"], pa.array(counts, pa.int64()),
                pa.array(hits, pa.list_(pa.list_(pa.int32()))),
                pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                pa.array(cut, pa.string())], ["row", "n_words", "hits", "items", "cut"])

    rows = packed(docs)
    return rows.mapInArrow(run, with_fields(
        rows.schema["row"],
        "n_words bigint, hits array<array<int>>, items array<string>, cut string"))


def contamination(docs, items, window=10, id_column="doc_id", text_column="text", **options):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    hit = with_hits(
        id_and_text(docs, id_column, text_column), items, window, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return hit.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def _cut(text, hits):
    """The text without the hit words and what stands between them."""
    places = [m.span() for m in _WORD_PLACES.finditer(text)]
    kept, at = [], 0
    for begin, end in hits:
        kept.append(text[at:places[begin][0]])
        at = places[end - 1][1]
    kept.append(text[at:])
    return "".join(kept)


def decontaminate(docs, items, window=10, most_coverage=0.5, text_column="text", **options):
    """``docs`` without the matched spans; a document of which more than
    ``most_coverage`` of the words are hit goes altogether."""
    hit = with_hits(docs, items, window, text_column=text_column, **options)
    share = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0]) / F.col(
        "n_words")
    kept = hit.where((F.col("n_words") == 0) | (share <= most_coverage))
    return kept.select(*(
        F.coalesce("cut", F.col("row")[name]).alias(name) if name == text_column
        else F.col("row")[name].alias(name) for name in docs.columns))
