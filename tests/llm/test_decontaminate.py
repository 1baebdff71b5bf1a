import random
import re

import pytest

from parleyframe.llm import decontaminate as dec
from tests.llm.conftest import LONG, ODD


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        size = min(window, len(iw))
        for s in range(len(iw) - size + 1 if size else 0):
            for at in range(len(w) - size + 1):
                if w[at:at + size] == iw[s:s + size]:
                    hit |= set(range(at, at + size))
                    names.add(name)
    return hit, names


def test_words():
    text = "Ab-c 9É x\x80y:Z@q[r`s{t ß"
    assert [w.decode() for w in dec.words_of(text)] == words(text)


@pytest.mark.parametrize("seed", range(60))
def test_matcher(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcd"
    items = [(str(k), " ".join(rng.choices(letters, k=rng.randrange(9)))) for k in range(8)]
    matcher = dec.Matcher(items, 4)
    for _ in range(20):
        text = " ".join(rng.choices(letters + "x", k=rng.randrange(30)))
        spans, names = matcher(dec.words_of(text))
        hit, expected = brute(text, items, 4)
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert names == expected


ITEMS = [(1, "The quick, brown fox jumps over a lazy dog while"), (2, "ran after"), (3, None),
         (None, "the cat sat on the mat and the dog ran after it again"), (1, "!!!"), (4, "")]


@pytest.mark.parametrize("shard_words", [500_000, 8])
def test_odd_rows(spark, odd, shard_words):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = dec.contamination(odd, items, shard_words=shard_words).collect()
    named = [("" if i is None else str(i), t) for i, t in ITEMS]
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, []).append(t)
    assert len(rows) == len(ODD)
    for row in rows:
        assert (row["n_words"], row["n_hit"], row["n_items"]) in {
            (len(words(t)), len(h), len(n)) for t in texts[row["doc_id"]] if t != LONG
            for h, n in [brute(t, named, 10)]} or row["doc_id"] == 6
        assert row["contaminated"] == (row["n_hit"] > 0)
    long = [r for r in rows if r["doc_id"] == 6][0]
    assert long["n_hit"] == 10 * 3000


def test_decontaminate(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = dec.decontaminate(odd, items, most_coverage=0.5)
    assert out.columns == odd.columns
    rows = out.collect()
    assert 1 in {r["doc_id"] for r in rows}  # the other text with this id
    assert not any("cat sat" in (r["text"] or "") for r in rows)
    kept = {r["doc_id"]: r["text"] for r in rows}
    assert kept[2] is None and kept[3] == "" and kept[10] == dict(ODD)[10]


def test_spans_are_cut_out(spark, documents):
    items = spark.createDataFrame(ITEMS[:1], "item_id bigint, text string")
    text = "Keep this part of the text, and more! The QUICK brown fox jumps over a lazy dog; while. Tail"
    rows = dec.decontaminate(documents([(1, text)]), items, most_coverage=0.9).collect()
    assert rows[0]["text"] == "Keep this part of the text, and more! . Tail"


def test_empty_tables(spark, odd, none):
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert all(not r["contaminated"] for r in dec.contamination(odd, no_items).collect())
    assert dec.contamination(none, no_items).collect() == []
