import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from shoplens.llm import simhash
from shoplens.llm.components import connected_components


def plain_print(text, words=4):
    found = (text or "").encode().lower().split()
    parts = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if parts else 0


def smallest(ids, near):
    label = dict(zip(range(len(ids)), range(len(ids))))
    while True:
        new = {a: min(label[b] for b in range(len(ids)) if near[a][b]) for a in label}
        if new == label:
            break
        label = new
    groups = {}
    for i, g in label.items():
        groups.setdefault(g, []).append(ids[i])
    return [min((x for x in groups[label[i]] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("bits", range(8))
def test_every_set_of_shared_positions_has_a_list(bits):
    lists = simhash.position_lists(bits)
    assert all(any(set(p) <= set(s) for p in lists) for s in combinations(range(8), 8 - bits))


def test_components_equal_brute_force(spark, odd, rows, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_CHUNK", 5)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = [t for _, t in odd.select("doc_id", "text").collect()]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 80))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base).upper())
    ids = [None if i % 40 == 7 else i for i in range(len(texts))]
    got = simhash.near_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
    prints = [plain_print(t) for t in texts]
    near = [[bin(a ^ b).count("1") <= 4 for b in prints] for a in prints]
    want = list(zip(ids, [f"{p:016x}" for p in prints], smallest(ids, near)))
    assert rows(got) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_tables(spark, odd, none):
    found = simhash.near_components(odd)
    assert found.columns == ["doc_id", "fingerprint", "component_id"] and found.count() == odd.count()
    assert simhash.near_components(none).count() == 0 and simhash.component_firsts(none).count() == 0


def test_one_row_of_each_component_is_first(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(5, base), (3, base), (3, base), (None, base), (7, None), (6, ""), (None, "a b c d e"), (None, "a b c d e"), (1, "other words altogether"), (1, "some thing else again")]
    found = simhash.component_firsts(spark.createDataFrame(rows, "doc_id long, text string"))
    bodies = {xxhash.xxh64_intdigest(t or "", 42): t or "" for _, t in rows}
    got = sorted((str(r.id), bodies[r.body % (1 << 64)]) for r in found.collect())
    assert got == sorted([("3", base), ("6", ""), ("None", "a b c d e"), ("1", "other words altogether"), ("1", "some thing else again")])


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_prefers_fewer_bits():
    a, b, bits = (np.array(x) for x in ([1, 1, 2, 5, 5], [2, 3, 3, 6, 6], [1, 4, 2, 3, 3]))
    kept = sorted(zip(*(x.tolist() for x in simhash.spanning(a, b, bits))))
    assert kept == [(1, 2, 1), (2, 3, 2), (5, 6, 3)]
