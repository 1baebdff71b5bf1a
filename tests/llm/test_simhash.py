import random

import pytest
import xxhash

from parleyframe.llm import simhash
from parleyframe.llm.components import components
from tests.llm.conftest import ODD


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    owner = {n: n for n in nodes}

    def find(n):
        while owner[n] != n:
            n = owner[n]
        return n
    for a, b in linked:
        a, b = find(a), find(b)
        owner[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_every_pair_within_the_radius_shares_a_mask():
    rng = random.Random(4)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(flips & mask == 0 for mask in simhash.MASKS)
    assert len(simhash.MASKS) == 31 and all(30 <= m.bit_count() <= 34 for m in simhash.MASKS)


def test_fingerprints():
    for _, text in ODD:
        assert simhash.fingerprint(text) == brute_print(text)
        assert simhash.fingerprint(text, at_once=3) == brute_print(text)


@pytest.mark.parametrize("paired", [1024, 3])
def test_links_join_what_is_within_the_radius(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(paired)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(12):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = {p: simhash._signed(p) for p in prints}
    near = [(signed[a], signed[b]) for a in prints for b in prints
            if a < b and (a ^ b).bit_count() <= 4]
    frame = spark.createDataFrame([(x,) for x in signed.values()], "fp bigint")
    found = [tuple(r) for r in simhash.links(frame).collect()]
    assert roots(signed.values(), found) == roots(signed.values(), near)


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark takes 31 masks of each fingerprint, or 500 points, for one row."""
    monkeypatch.setattr(simhash, "PAIRED", 2)
    tables = []
    monkeypatch.setattr(simhash, "settle", lambda table, name: tables.append(table) or table)
    tables.append(simhash.links(spark.range(1000).withColumnRenamed("id", "fp")))
    assert len(tables) == 2
    for table in tables:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" in plan and "BroadcastExchange" not in plan


def test_components(spark):
    rng = random.Random(9)
    linked = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    linked += [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 440)]
    found = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(linked, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in linked if a != b for n in (a, b)}
    assert found == roots(nodes, linked)


def test_near_duplicates(documents):
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(120))) for k in range(30)]
    rows += [(100 + k, rows[k % 6][1] + f" w{k}") for k in range(40)]
    rows += [(200 + k, rows[3][1]) for k in range(20)] + [(300, None), (301, " "), (None, rows[4][1])]
    prints = {i: brute_print(t) for i, t in rows}
    ids = [i for i, _ in rows if i is not None]
    expected = roots(ids, [(a, b) for a in ids for b in ids
                           if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    found = simhash.near_duplicates(documents(rows).repartition(4)).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row["fingerprint"] == f"{prints[row['doc_id']]:016x}"
        assert row["component_id"] == expected[4 if row["doc_id"] is None else row["doc_id"]]


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert len(ids) == len({simhash.fingerprint(t) for _, t in ODD})
    assert 2 in ids and 3 not in ids and 4 not in ids and 11 not in ids


def test_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []
