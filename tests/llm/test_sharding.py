import zlib
from collections import Counter, defaultdict

from shoplens.llm import sharding


def test_longest_first_to_the_least_loaded():
    assert sharding.schedule([(1, 5), (2, 4), (3, 3), (4, 3), (5, 3)], 2) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}
    assert sharding.schedule([], 3) == {}


def check(rows, texts, shards):
    bodies = defaultdict(set)
    slots = defaultdict(list)
    loads = Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    for i, t in texts:
        mine = [r for r in rows if r.doc_id == i and r.text_crc32 == zlib.crc32((t or "").encode())]
        assert mine and all(r.size == len((t or "").encode()) + 8 for r in mine)
        bodies[t or ""] |= {r.shard for r in mine}
    assert len(rows) == len(texts) and all(r.law == "bytes" and r.grown_shard is None for r in rows)
    assert all(len(s) == 1 for s in bodies.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return [loads[s] for s in range(shards)]


def test_odd_rows(spark, odd, none):
    rows = sharding.assign_shards(odd, 3).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert sharding.assign_shards(none).count() == 0


def test_bundles_even_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE_PER_SHARD", 5)
    monkeypatch.setattr(sharding, "BUNDLES_PER_SHARD", 20)
    texts = [(i, f"{i} " * (1 + i * i % 97)) for i in range(3000)] + [(5000 + i, "hot " * 20) for i in range(300)]
    loads = check(sharding.assign_shards(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect(), texts, 4)
    assert max(loads) - min(loads) < 0.002 * sum(loads)
