import numpy as np
import pytest

from shoplens.llm.cover_tree import BASE, Best, CoverTree, _blocks, _placed, block_pairs, dual_search, surviving_pairs, top_k

SCHEMA = "vec_id long, embedding array<float>, block string, vector string"


def brute(rows, k, every):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in good]
    out = []
    for q, a in whole:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(df, **kw).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("blocks", [(1024, 4096), (7, 60)])
def test_equals_brute_force_with_ties_and_copies(spark, blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] * (i % 3 > 0) + rng.normal(scale=0.1, size=6)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + rows[:5]
    assert found(spark, rows, k=20, every=20, query_block=blocks[0], data_block=blocks[1]) == brute(rows, 20, 20)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (20, [3.0]),
            (40, [2.0, -1.0]), (5, [1e30, 1.0]), (60, [])]
    got = found(spark, rows)
    assert [r for r in got if r[2] != 5 and r[0] != 5] == [(0, 2, 40, 0), (40, 2, 0, 0)]
    assert (0, 1, 5, (1 << 63) - 1) in got  # beyond a long: its end
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(5)
    data = np.floor(rng.normal(size=(3000, 4)) * 100)
    data[:1000] *= 10
    tree, queries = CoverTree.build(np.arange(3000), data), CoverTree.build(np.arange(3000, 3100), data[:100] + 1)
    best = Best(queries, 5)
    dual_search(queries, tree, best)
    scores = np.sort(queries.rows @ data.T, axis=1)[:, ::-1][:, :5]
    assert (best.scores == scores).all()
    # A ball covers its rows.
    for b, e, c, r in zip(tree.begin, tree.end, tree.centre, tree.radius):
        assert np.linalg.norm(tree.rows[b:e] - c, axis=1).max() <= r + 1e-9


@pytest.mark.parametrize("shape", ["spread", "outlier", "copies", "one", "few"])
def test_levels_are_nested_separated_and_cover(shape):
    rng = np.random.default_rng(8)
    rows = np.floor(rng.normal(size=(2000, 3)) * 300)
    if shape == "outlier":
        rows[7] = 1e6
    if shape == "copies":
        rows[100:] = rows[:19].repeat(100, axis=0)
    if shape == "one":
        rows[:] = 5
    if shape == "few":
        rows = rows[:3]
    tree = CoverTree.build(np.arange(len(rows)), rows)
    assert sorted(tree.ids) == list(range(len(rows))) and (tree.rows == rows[tree.ids]).all()
    assert (tree.begin[0], tree.end[0]) == (0, len(rows))
    for level in set(tree.level.tolist()):
        net = tree.rows[sorted({int(a) for a, n in zip(tree.at, tree.level) if n >= level})]
        apart = np.linalg.norm(net[:, None] - net[None], axis=2)[~np.eye(len(net), dtype=bool)]
        assert (apart > BASE**level).all()
    for node, below in enumerate(tree.children):
        if below:
            assert tree.at[node] in tree.at[below]
            assert (np.linalg.norm(tree.centre[below] - tree.centre[node], axis=1) <= BASE ** (tree.level[below] + 1.0)).all()
            assert tree.begin[below].tolist() == [tree.begin[node], *tree.end[below][:-1]] and tree.end[below][-1] == tree.end[node]
    if shape in ("spread", "outlier"):
        assert len(set(tree.level.tolist())) > 3
    again = CoverTree.unpacked(tree.packed())
    assert (again.rows == tree.rows).all() and again.children == tree.children


def test_blocks_that_cannot_hold_a_best_score_are_not_sent(spark):
    rng = np.random.default_rng(9)
    centres = np.linalg.qr(rng.normal(size=(8, 8)))[0] * 10
    rows = [(i, (centres[i % 8] + rng.normal(scale=0.05, size=8)).astype(np.float32).tolist()) for i in range(1600)]
    df = spark.createDataFrame([(i, [float(x) for x in v], 8) for i, v in rows], "id long, vector array<double>, dims int")
    placed = _placed(df, 16)
    queries, data = _blocks(placed.filter("id % 20 = 0"), 50, "q"), _blocks(placed, 100, "d")
    every, kept = block_pairs(queries, data).count(), surviving_pairs(queries, data, 5).count()
    assert 0 < kept < every / 2
    assert found(spark, rows, k=5, every=20, query_block=50, data_block=100) == brute(rows, 5, 20)
