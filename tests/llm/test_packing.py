import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parleyframe.llm import packing
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
FILE = open(PATH, encoding="utf-8").read()
WHOLE = Tokenizer.from_str(FILE)
ENCODER = packing.WordEncoder(FILE)


def ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aAbzÉßİ'.,!#|3½ \n\t\xa0\x1cΣσé́🙂<|>ñ")), max_size=40))
def test_words_apart_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(ENCODER([text])[0], "<u4").tolist() == ids(text)


def test_odd_texts():
    for _, text in ODD:
        assert np.frombuffer(ENCODER([text or ""])[0], "<u4").tolist() == ids(text or "")


def test_marks_after_letters_are_read_once(monkeypatch):
    encoder = packing.WordEncoder(FILE)
    texts = [f"one{mark} two{mark}, three'{mark} a{mark}b {mark}" for mark in packing._MARKS]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == list(map(ids, texts))
    read, own = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda words: read.extend(words) or own(words))
    encoder(["four$$$ five$$$ six$$$"])
    assert read == ["$$$"]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 3)
    encoder = packing.WordEncoder(FILE)
    for text in ["one two three four", "two five", "two six!", "one two seven"]:
        (found,) = encoder([text])
        assert np.frombuffer(found, "<u4").tolist() == ids(text)
    assert set(encoder.words) == {"one", "two", "seven"}


def check(rows, texts, capacity):
    expected = []
    for i, text in texts:
        all_ids = ids(text or "") + [packing.END]
        expected += [
            (i, k, s, len(all_ids[s:s + capacity]),
             zlib.crc32(np.array(all_ids[s:s + capacity], "<u4").tobytes()))
            for k, s in enumerate(range(0, len(all_ids), capacity))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    sequences = defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack(documents):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choices(["house", "tree", "green"], k=int(rng.expovariate(1 / 30)))))
             for k in range(300)]
    rows = packing.pack(documents(texts).repartition(4), PATH, 64).collect()
    used = check(rows, texts, 64)
    assert used <= -(-sum(r["length"] for r in rows) // 64) + 1


def test_odd_rows(odd):
    check(packing.pack(odd, PATH).collect(), ODD, packing.CAPACITY)


def test_empty_table(none):
    assert packing.pack(none, PATH).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_rounds_place_everything_once(seed):
    rng = random.Random(seed)
    top = rng.choice([1, 7, 50, 400])
    counts = {s: rng.randrange(1, 30) for s in rng.sample(range(1, top + 1), rng.randint(1, top))}
    runs = sorted(packing.Rounds(counts, top).run())
    fill, members = defaultdict(list), 0
    for i, (size, first, sequence, offset) in enumerate(runs):
        last = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == size else counts[size]
        for rank in range(first, last):
            fill[sequence + rank - first].append((offset, size))
            members += 1
    assert members == sum(counts.values())
    for held in fill.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= top
    bound = -(-sum(s * n for s, n in counts.items()) // top)
    big = sum(n for s, n in counts.items() if s * 2 > top)
    assert len(fill) <= max(bound, big) * 1.3 + 2
