import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from parleyframe.llm import collocations

FOLDER = "/root/testdata/sf0.001"


def brute(pairs, least, first=2000):
    f, n = Counter(), Counter()
    for lang, text in pairs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, 6)
                     for i in range(len(words) - k + 1))
    chosen = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for (lang, *words), a in chosen.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                p = (lang, *words[i:i + k])
                inside[p] = max(inside[p], a)
    by_lang = {}
    for p, a in chosen.items():
        if inside[p] < a:
            lang = p[0]
            cuts = [(1000 * a * n[lang] // (f[p[:k]] * f[(lang, *p[k:])]), k)
                    for k in range(2, len(p))]
            score, k = min(cuts)
            by_lang.setdefault(lang, []).append(
                (-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(lang, *p[k:])]))
    return {(lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
            for lang, found in by_lang.items()
            for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1)}


def result(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs, [(r["lang"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize("least, first, sizes", [
    (100, 2000, {}), (4, 70, {}),
    # Small units and buckets: words that are frequent only together, deep routes.
    (4, 10 ** 6, {"UNIT_WORDS": 3000, "SENT_WORDS": 2000, "BUCKET": 20, "CELLS": 4096})])
def test_whole_table(table, monkeypatch, least, first, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(collocations, name, value)
    expected = brute(table[1], least, first)
    assert len(expected) > 20
    assert result(collocations.collocations(table[0], least=least, first=first)) == expected


def test_overlaps_ties_and_pieces(documents):
    text = "na na na na, b c. B c\tb c; b\nc é ü, é ü! x y z x y z"
    docs = documents([(1, text), (1, text), (None, text)], "en").unionByName(
        documents([(2, "b c b c"), (3, "b c"), (4, None)], None))
    pairs = [(r["lang"], r["text"]) for r in docs.collect()]
    for least in (1, 2, 3, 6):
        assert result(collocations.collocations(docs, least=least)) == brute(pairs, least)


def test_same_hash_draws_others(documents, monkeypatch):
    plain, drawn = collocations._hashes, []

    def weak(names, seed):
        drawn.append(seed)
        return plain(names, seed) if seed else plain(names, seed) % np.uint64(3)
    monkeypatch.setattr(collocations, "_hashes", weak)
    docs = documents([(1, "a b c d a b c d a b")], "en")
    assert result(collocations.collocations(docs, least=2)) == brute(
        [("en", "a b c d a b c d a b")], 2)


def test_odd_rows(odd):
    pairs = [(r["lang"], r["text"]) for r in odd.collect()]
    assert result(collocations.collocations(odd, least=2)) == brute(pairs, 2)


def test_no_rows(none):
    assert collocations.collocations(none).collect() == []


def test_rare_pairs_are_not_sent(documents, monkeypatch):
    # Every word is frequent, and of the pairs only "new york" and "york city".
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.permutation(np.repeat(np.arange(300), 40)))
    text += ". new york city" * 40
    plain, sent = collocations._sorted, []

    def watched(buckets, least):
        sent.append(sum(collocations._unpacked(r["suffixes"])[1].sum() for r in buckets.collect()))
        return plain(buckets, least)
    monkeypatch.setattr(collocations, "_sorted", watched)
    assert result(collocations.collocations(documents([(1, text)], "en"), least=40)) == brute(
        [("en", text)], 40)
    assert 80 <= sent[0] < 200


def test_counts_of_cells_come_back():
    cells, counts = np.array([0, 1, 255, 256, 65535]), np.array([1, 255, 256, 70000, 2 ** 32 - 1])
    found, many = collocations._unpacked_cells(
        zstandard.ZstdCompressor().compress(collocations._packed_cells(cells, counts)))
    assert found.tolist() == cells.tolist() and many.tolist() == counts.tolist()


def test_long_text_in_chunks(documents, monkeypatch):
    monkeypatch.setattr(collocations, "_CHUNK", 50)
    text = "one two three, four five. " * 40 + "six seven " * 30
    assert result(collocations.collocations(documents([(1, text)], "en"), least=3)) == brute(
        [("en", text)], 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=2, max_size=5), min_size=1, max_size=60),
       st.integers(1, 6))
def test_equal_partitions(suffixes, least):
    keys = np.array([x + [0] * (5 - len(x)) for x in suffixes], np.uint64).T
    number = np.arange(1, len(suffixes) + 1) % 3 + 1
    expected = Counter()
    for x, n in zip(suffixes, number):
        for k in range(2, len(x) + 1):
            expected[tuple(x[:k])] += int(n)
    length, head, count = collocations.equal_partitions(
        keys, number, np.full(len(suffixes), 2), least)
    found = {tuple(int(x) for x in keys[:k, h]): int(n) for k, h, n in zip(length, head, count)}
    assert len(found) == len(length)
    assert found == {p: n for p, n in expected.items() if n >= least}
