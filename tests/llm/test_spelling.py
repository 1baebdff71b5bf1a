import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parleyframe.llm import spelling

FOLDER = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(pairs, least=5):
    counts = {}
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    near = {w: [] for w in counts}
    # One edit leaves a word with one letter left out in common.
    holes = {}
    for w in counts:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            holes.setdefault(x, []).append(w)
    for w in counts:
        around = {x for i in range(len(w)) for x in holes[w[:i] + w[i + 1:]]} | set(holes[w])
        near[w] = [x for x in around if one_edit(w, x)]
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w]))
            for w, n in counts.items()}


def result(frame):
    rows = [tuple(r) for r in frame.select(
        "word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sizes", [{}, {"CELL": 40, "POINTS": 15, "QUESTIONS": 25}])
def test_whole_table(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(spelling, name, value)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = brute((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(expected) > 100
    assert result(spelling.variants(docs)) == expected


def test_chain_and_ties(documents):
    text = " ".join(["painting"] * 125 + ["paintinG"] * 0 + ["paintin"] * 25 + ["aintin"] * 5
                    + ["gardens"] * 5 + ["xardens"] * 25 + ["bardens"] * 25)
    docs = documents([(i, text) for i in (3,)])
    rows = {r["word"]: r for r in spelling.variants(docs).collect()}
    assert result(spelling.variants(docs)) == brute([(3, text)])
    assert (rows["aintin"]["form"], rows["aintin"]["root"]) == ("paintin", "painting")
    assert rows["gardens"]["form"] == "bardens" and rows["gardens"]["n_near"] == 2


def test_odd_rows(odd, rows):
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(spelling.variants(odd)) == brute(pairs)
    assert spelling.variants(odd).schema.simpleString() == (
        "struct<word:string,form:string,root:string,n:bigint,n_near:bigint,form_n:bigint>")


def test_no_rows(none):
    assert spelling.variants(none).collect() == []


def test_a_very_long_word(documents):
    word = "x" * 5000
    docs = documents([(i, f"{word} {word[1:]} {word}é") for i in range(1, 7)])
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(spelling.variants(docs)) == brute(pairs)


WORDS = st.lists(st.text("abé", min_size=6, max_size=9), min_size=1, max_size=60, unique=True)


@settings(max_examples=60, deadline=None)
@given(WORDS, st.integers(1, 8))
def test_tree_reaches_every_near_word(words, leaf):
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for size, points in by_size.items():
        codes = spelling._codes(points, size)
        tree = spelling.grow(spelling.letter_counts(codes), leaf)
        assert sorted(i for x in tree if x[0] is None for i in x[1]) == list(range(len(points)))
        sketch = spelling._sketch(spelling.letter_counts(codes))
        for asking, budget in ((size, 2), (size - 1, 1)):
            own = by_size.get(asking, [])
            if own:
                found = {(own[i], points[j]) for a, b in spelling._pairs(
                    tree, sketch, codes, spelling._codes(own, asking), budget)
                    for i, j in zip(a, b)}
                assert found == {(x, y) for x in own for y in points if one_edit(x, y)}


def test_boxes_prune():
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 123, (4000, 8)).astype(np.uint32)
    counts = spelling.letter_counts(codes)
    tree = spelling.grow(counts, 16)
    visits = sum(len(rows) for _, rows in spelling.reached(
        tree, counts[:100], np.full(100, 2)))
    assert visits < 0.4 * 100 * sum(x[0] is None for x in tree)
