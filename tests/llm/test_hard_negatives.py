"""Hard negatives, against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import hard_negatives as op


def brute_mine(rows, is_anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    """(id, label, vector) rows with distinct ids -> result rows."""
    whole = {}
    for key, label, vec in rows:
        if None in (key, label) or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole[key] = (label, [math.floor(scale * x) for x in vec])
    out = []
    for a, (label, point) in whole.items():
        if not is_anchor(a):
            continue
        score = {k: sum(x * y for x, y in zip(point, p)) for k, (_, p) in whole.items() if k != a}
        order = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in order if whole[k][0] == label][:positives]:
            fit = [k for k in order if whole[k][0] != label and low * score[p] <= 100 * score[k] <= high * score[p]]
            out += [(a, p, rank, k, score[p], score[k]) for rank, k in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, kind="array<float>", **options):
    df = spark.createDataFrame([(*r, 1, 0) for r in rows], f"vec_id long, label int, embedding {kind}, shard int, point int")
    return sorted(map(tuple, op.mine(df.repartition(3), F.col("vec_id") % 10 == 0, **options).collect()))


def clustered(seed, n, dim, groups, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)).astype(np.float32)
    picked = rng.integers(0, groups, n)
    vecs = (centres[picked] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(int(i), int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(vecs)]


@pytest.mark.parametrize("seed,dim,groups,spread,shard", [(1, 12, 6, 0.1, 4096), (2, 12, 6, 0.1, 60), (3, 24, 1, 1.0, 100), (4, 3, 300, 0.0, 50)])
def test_equals_all_products(spark, monkeypatch, seed, dim, groups, spread, shard):
    monkeypatch.setattr(op, "SHARD_ROWS", shard)
    monkeypatch.setattr(op, "ANCHORS", 5)
    rows = clustered(seed, 420, dim, groups, spread)
    got = mined(spark, rows)
    assert got == brute_mine(rows, lambda k: k % 10 == 0) and got


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_ROWS", 7)
    monkeypatch.setattr(op, "SUMMARY", 2)
    same = [1.0, 0.5, 0.25]
    rows = [(i, i % 3, same) for i in range(60)]  # ties everywhere, one vector
    rows += [(None, 1, same), (100, None, same), (110, 1, None), (120, 1, [1.0, None, 0.0]), (130, 1, [float("nan"), 0.0, 0.0]),
             (140, 1, [float("inf"), 0.0, 0.0]), (150, 1, []), (160, 2, [0.1]), (170, 9, same), (180, 1, [-1.0, -1.0, -1.0]), (-10, 0, same),
             (2**62, 0, [0.9, 0.5, 0.25]), (-(2**63) + 8, 0, same)]
    assert mined(spark, rows) == brute_mine(rows, lambda k: k % 10 == 0)
    assert mined(spark, rows, low=50, high=90, positives=2, negatives=3) == brute_mine(rows, lambda k: k % 10 == 0, 2, 3, 50, 90)
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [])]) == []
    repeated = [r for r in rows[:30] for _ in range(3)]
    assert mined(spark, repeated) == brute_mine(rows[:30], lambda k: k % 10 == 0)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, [float(x) for x in rng.integers(-(2**27), 2**27, 3) / 1.0]) for i in range(80)]
    rows += [(100 + i, i % 2, [float(2**27 - i), 1.0, 2.0]) for i in range(20)]
    assert mined(spark, rows, "array<double>", scale=4) == brute_mine(rows, lambda k: k % 10 == 0, scale=4)


def tree_of(seed, n, spread):
    rows = clustered(seed, n, 8, 12, spread)
    points = np.floor(256 * np.array([r[2] for r in rows])).astype(np.int64)
    return op.CoverTree.build(np.arange(n), np.array([r[1] for r in rows]), points)


def test_radii_cover_and_shrink():
    tree = op.CoverTree.load(tree_of(5, 2_000, 0.02).dump())
    real = np.c_[tree.points, np.sqrt(np.maximum(tree.norm**2 - (tree.points**2).sum(axis=1), 0))]
    assert sorted(tree.ids.tolist()) == list(range(2_000))
    for n in range(len(tree.radius)):
        far = np.linalg.norm(real[tree.first[n] : tree.last[n]] - real[tree.centre[n]], axis=1).max()
        assert far <= tree.radius[n] + 1e-6
        children = range(tree.child[n], tree.child_end[n])
        assert all(tree.radius[c] <= op.SHRINK * tree.radius[n] * (1 + 1e-6) + 1e-6 for c in children)
        if children:
            assert sum(tree.last[c] - tree.first[c] for c in children) == tree.last[n] - tree.first[n]


def test_search_skips_nodes_outside_of_the_window(monkeypatch):
    tree, seen = tree_of(6, 4_000, 0.02), []
    scores = op.CoverTree.scores
    monkeypatch.setattr(op.CoverTree, "scores", lambda self, a, rows: seen.append(len(rows)) or scores(self, a, rows))
    anchor = tree.exact_points[17]
    products = tree.exact_points @ anchor
    for low, high in ((-np.inf, np.inf), (0, 20_000), (products.max() // 2, products.max() * 3 // 4)):
        seen.clear()
        best = op.Nearest(5, low, high)
        op.descend(tree, anchor[None, :], [[best]], [lambda ids, labels: ids >= 0])
        want = sorted((-s, i) for s, i in zip(products.tolist(), tree.ids.tolist()) if low <= s <= high)[:5]
        assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == want
        assert sum(seen) < 1_500
