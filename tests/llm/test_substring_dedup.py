import random

import numpy as np
import pytest

from parleyframe.llm import substring_dedup as sub
from tests.llm.conftest import ODD


def brute(rows, width):
    """Expected (id, words, removed, kept) per row, repeated rows included."""
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - width + 1):
            place = (i is not None, i or 0, s)
            window = tuple(w[s:s + width])
            first[window] = min(first.get(window, place), place)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - width + 1):
            if (i is not None, i or 0, s) > first[tuple(w[s:s + width])]:
                gone |= set(range(s, s + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=repr)


def got(frame, **options):
    return sorted(map(tuple, sub.deduplicate(frame, **options).collect()), key=repr)


@pytest.mark.parametrize("unit_words", [7, 10_000])
def test_small_vocabulary(documents, unit_words):
    rng = random.Random(unit_words)
    rows = [(k, " ".join(rng.choices("abc", k=rng.randrange(40)))) for k in range(60)]
    rows += [(100 + k, "x y z " * 10) for k in range(30)]
    rng.shuffle(rows)
    assert got(documents(rows).repartition(5), width=4, buckets=3, unit_words=unit_words) == brute(
        rows, 4)


def test_odd_rows(odd):
    assert got(odd, width=5) == brute(ODD, 5)


def test_empty_table(none):
    assert got(none) == []


def test_hashes_depend_on_the_window_alone():
    words = np.array([3, 1, 4, 1, 5, 9, 3, 1, 4], np.uint64)
    hashes = sub.window_hashes(words, 3, sub._BASES[0])
    assert hashes[0] == hashes[6] and len(set(hashes.tolist())) == 6


def test_places_survive_packing():
    places = np.array([0, 5, 300, 70_000, 9_000_000, 9_000_001])
    low, high, rest = sub._steps(places)
    assert sub._places(low, high, sub._bytes(rest)).tolist() == places.tolist()
