"""Vector operators against all pairs, on nulls, zeros, odd numbers, ties, repeated rows and other dimensions."""

import math

import numpy as np
import pytest

from cumulo.llm import topk, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, rep string, score string, dim string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(80)]
    out += [(100 + i, [float(np.float32(x)) for x in np.array(out[i % 3][1]) + rng.normal(scale=0.05, size=8)]) for i in range(30)]
    out += [(200 + i, out[5][1]) for i in range(6)] + [(3, out[3][1])]
    out += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [1.0, None] + [0.0] * 6), (305, [float("inf")] + [1.0] * 7), (306, [1.0, 2.0]), (350, [2.0, 4.0]), (None, out[0][1])]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(6)


def good(v, zero=True):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


@pytest.mark.parametrize("tile_rows", [3, 1000])
def test_links_are_all_pairs(vectors, rows, tile_rows):
    real = [(i, np.array(np.float32(v), float) if good(v, False) and i is not None else None) for i, v in rows]
    n = len(real)
    links, root = [0] * n, list(range(n))
    for a in range(n):
        for b in range(a):
            u, v = real[a][1], real[b][1]
            if u is None or v is None or len(u) != len(v) or u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) < 0.95 - 1e-12:
                continue
            links[a] += 1
            links[b] += 1
            x, y = root[a], root[b]
            root = [y if r == x else r for r in root]
    part = {}
    for k in range(n):
        part.setdefault(root[k], []).append(real[k][0])
    wanted = sorted(((real[k][0], links[k], None if real[k][0] is None else min(part[root[k]])) for k in range(n)), key=str)
    found = vector_dedup.near_duplicates(vectors, tile_rows=tile_rows).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_tables_hold_the_recall():
    for n in (10, 10_000, 10**9):
        bits, tables = vector_dedup.plan(n, 0.95, 1e-4)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= 1e-4


def plain_top(rows, k=5):
    """Every other row's score for each different query row, best first; a row with the query's id doesn't count."""
    out = []
    for q, point in {(i, tuple(p)) for i, p in rows if i % 50 == 0}:
        scores = sorted((-int(np.dot(np.array(point, object), np.array(p, object))), i) for i, p in rows if i != q and len(p) == len(point))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [16, 10_000])
def test_top_k_is_all_scores(vectors, rows, shard_rows):
    points = [(i, np.floor(256 * np.array(np.float32(v), float)).astype(int).tolist()) for i, v in rows if good(v) and i is not None]
    table = topk.quantized(vectors)
    found = topk.top_k(table, table.where("vec_id % 50 = 0"), shard_rows=shard_rows, block_rows=3, leaf_rows=4).collect()
    assert sorted(map(tuple, found)) == plain_top(points)


def test_top_k_ties_and_big_numbers(spark):
    rows = [(50, [2**40, 1]), *((i, [2**20, -3]) for i in range(1, 9)), (9, [2**21, 2**40])]
    table = spark.createDataFrame(rows, "vec_id long, point array<long>")
    found = [tuple(r) for r in topk.top_k(table, table.where("vec_id = 50"), shard_rows=4, leaf_rows=2).collect()]
    assert sorted(found) == plain_top(rows) == [(50, 1, 9, 2**61 + 2**40), *((50, r, r - 1, 2**60 - 3) for r in range(2, 6))]


@pytest.mark.parametrize("shard_rows", [4, 10_000])
def test_top_k_counts_repeated_candidates(spark, shard_rows):
    rows = [(50, [1, 0]), (100, [1, 0]), (50, [1, 0]), (50, [0, 1]), *[(1, [100, 0])] * 3, *((2, [90, y]) for y in range(6)), *[(7, [95, 0])] * 40, *((i, [80 - i, 0]) for i in range(3, 20))]
    table = spark.createDataFrame(rows, "vec_id long, point array<long>")
    found = sorted(map(tuple, topk.top_k(table, table.where("vec_id % 50 = 0"), shard_rows=shard_rows, block_rows=2, leaf_rows=2).collect()))
    assert found == plain_top(rows) and [f[2:] for f in found if f[0] == 100] == [(1, 100)] * 3 + [(7, 95)] * 2
    few = spark.createDataFrame([(50, [1, 0]), *[(7, [1, 0])] * 6, *((i, [0, i]) for i in range(1, 6))], "vec_id long, point array<long>")
    assert [r.vec_id for r in topk.top_k(few, few.where("vec_id = 50")).collect()] == [7] * 5


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_top_k_of_long_points(spark, monkeypatch, most):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", most)
    rng = np.random.default_rng(4)
    rows = [(i, [int(x) for x in rng.integers(-300, 300, 2048)]) for i in range(0, 1300)]
    table = spark.createDataFrame(rows, "vec_id long, point array<long>").repartition(4)
    found = sorted(map(tuple, topk.top_k(table, table.where("vec_id % 400 = 0")).collect()))
    points = np.array([p for _, p in rows])
    want = []
    for q in range(0, 1300, 400):
        scores = points @ points[q]
        order = [i for i in np.lexsort((np.arange(1300), -scores)) if i != q][:5]
        want += [(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(order)]
    assert found == want


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(2)
    points = rng.integers(-100, 100, (300, 5))
    tree = topk.build(np.arange(300), points, 16)
    for (a, b), low, high, child in zip(tree.span, tree.low, tree.high, tree.child):
        assert (tree.points[a:b].min(axis=0) == low).all() and (tree.points[a:b].max(axis=0) == high).all()
        assert child[0] >= 0 or b - a <= 16
    assert (points[tree.ids] == tree.points).all()


def test_empty_tables(vectors):
    none = vectors.where("false")
    assert vector_dedup.near_duplicates(none).count() == 0
    table = topk.quantized(none)
    assert topk.top_k(table, table).count() == 0
    some = topk.quantized(vectors)
    assert topk.top_k(some, some.where("false")).count() == 0
