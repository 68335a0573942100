"""Hard negatives and top-k search against plain versions; what their bounds leave out."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quarryline.llm")
from quarryline.llm import hard_negatives, segment_search, vectors  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score string"


def points(seed=3, n=400, dim=12):
    """Vectors in clusters, with copies, repeated ids, and rows that take no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dim))
    x = centres[r.integers(0, 9, n)] + r.normal(size=(n, dim)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), [float(np.float32(v)) for v in x[i]], int(r.integers(0, 3))) for i in range(n)]
    rows += [(n + k, rows[7][1], k % 3) for k in range(120)]  # copies of one vector
    rows += [rows[20], rows[100], (5, rows[6][1], 1), (-100, rows[3][1], 2)]
    rows += [(900, None, 1), (950, [0.5, None] + [0.0] * (dim - 2), 1), (1000, [float("nan")] * dim, 1), (1050, [float("inf")] * dim, 1), (1100, rows[0][1], None), (None, rows[0][1], 1), (1150, [0.25], 1), (1200, [], 2), (1300, [0.0] * dim, 0)]
    return rows


def sound(rows, labelled):
    good = [r for r in rows if r[0] is not None and r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and (r[2] is not None or not labelled)]
    dim = max(len(r[1]) for r in good)
    return good, np.array([[np.floor(256 * v) for v in r[1]] + [0] * (dim - len(r[1])) for r in good], dtype=np.int64)


def first(order, k):
    return sorted(order, key=lambda x: (-x[0], x[1]))[:k]


def brute_negatives(rows, anchors=100):
    good, x = sound(rows, True)
    scores, out = x @ x.T, []
    for a, (i, _, label) in enumerate(good):
        if i % anchors == 0:
            others = [(int(scores[a, b]), r[0], r[2] == label) for b, r in enumerate(good) if b != a]
            for p, j, _ in first([o for o in others if o[2]], 5):
                fit = first([o for o in others if not o[2] and 80 * p <= 100 * o[0] <= 100 * p], 5)
                out += [(i, j, k + 1, o[1], p, o[0]) for k, o in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("leaf, block", [(64, 4096), (8, 40)])
def test_hard_negatives(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SPAN", 3)
    rows = points()
    out = hard_negatives.mine(frame(spark, rows), F.col("label"), F.col("vec_id") % 20 == 0)
    got = sorted(tuple(r)[:6] for r in out.collect())
    assert got == brute_negatives(rows, 20) and len(got) > 300
    empty = hard_negatives.mine(frame(spark, []), F.col("label"), F.col("vec_id") % 20 == 0)
    assert empty.count() == 0 and empty.columns == out.columns


def test_windows_leave_out_subtrees(monkeypatch):
    """Every row in a window is in a visited leaf, and most leaves aren't visited where vectors lie in clusters."""
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    _, x = sound(points(n=2000), True)
    x = x.astype(float)
    tree = hard_negatives.Tree(x[:600], float((x * x).sum(axis=1).max()), len(x))
    leaves = {}

    def seen(k, d, near):
        m = len(tree.points[k])
        lo, hi = tree.ranges.setdefault(k, (np.full((m, m), np.inf), np.full((m, m), -np.inf)))
        for j in np.unique(near):
            lo[:, j] = np.minimum(lo[:, j], d[near == j].min(axis=0))
            hi[:, j] = np.maximum(hi[:, j], d[near == j].max(axis=0))

    at = tree.place(x, seen)
    anchors = x[::50]
    scores = anchors @ x.T
    top = np.sort(scores, axis=1)[:, -6]
    low, high = np.stack([0.97 * top, np.full(len(top), 1.0)], 1), np.stack([top, np.zeros(len(top))], 1)
    for leaf, who in tree.visits(anchors, low, high):
        leaves[leaf] = who
    inside = (scores >= low[:, :1]) & (scores <= high[:, :1])
    for a, b in zip(*np.nonzero(inside), strict=True):
        assert leaves[at[b]][a]
    visited = sum(int(w.sum()) for w in leaves.values())
    assert tree.leaves > 60 and visited < 0.5 * tree.leaves * len(anchors)


def brute_nearest(rows, every, k=5):
    good, x = sound(rows, False)
    scores, out = x @ x.T, []
    for a, r in enumerate(good):
        if r[0] % every == 0:
            for rank, (s, i) in enumerate(first([(int(scores[a, b]), o[0]) for b, o in enumerate(good) if b != a], k)):
                out.append((r[0], rank + 1, i, s))
    return sorted(out)


@pytest.mark.parametrize("sample, block", [(2048, 4096), (20, 50)])
def test_segment_search(spark, monkeypatch, sample, block):
    monkeypatch.setattr(segment_search, "SAMPLE", sample)
    monkeypatch.setattr(segment_search, "BLOCK", block)
    monkeypatch.setattr(segment_search, "QUERIES", 30)
    rows = points()
    out = segment_search.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in out.collect()) == brute_nearest(rows, 10)
    few = segment_search.nearest(frame(spark, rows[:3]), F.col("vec_id") % 2 == 0)
    assert sorted(tuple(r) for r in few.collect()) == brute_nearest(rows[:3], 2)
    assert segment_search.nearest(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 3, 12, 64, 100])
def test_bounds_hold_at_every_resolution(dim):
    r = random.Random(dim)
    x = np.array([[r.randrange(-256, 256) for _ in range(dim)] for _ in range(60)], dtype=float)
    scores, before = x @ x.T, None
    for segments in segment_search.resolutions(dim):
        f = segment_search.statistics(x, segments)
        bound = f @ f.T
        assert (bound >= scores - 1e-6).all()
        assert before is None or bound.sum() <= before.sum() + 1e-3
        before = bound


def test_most_pairs_drop_out_in_clusters():
    _, x = sound(points(n=3000, dim=32), False)
    x = x.astype(float)
    counts = np.zeros(len(segment_search.resolutions(x.shape[1])) + 1)
    scores = x[:100] @ x.T
    least = np.sort(scores, axis=1)[:, -6]
    at, open_ = segment_search.survivors(x[:100], x, least, counts)
    assert (scores >= least[:, None])[:, np.setdiff1d(np.arange(len(x)), at)].sum() == 0
    assert counts[0] == 100 * len(x) and (np.diff(counts) <= 0).all() and counts[-1] < 0.5 * counts[0]


def test_products_are_exact():
    a = np.array([[2.0**40, 1.0], [3.0, -(2.0**52)]])
    assert vectors.products(a, a).tolist()[0][1] == 3 * 2**40 - 2**52
    assert vectors.products(a * 2**20, a * 2**20).max() == vectors.LARGEST
    assert vectors.products(np.zeros((2, 0)), np.zeros((3, 0))).shape == (2, 3)
    assert vectors.matrix(pd.Series([[1.5, -0.5], [2.0]]), 2).tolist() == [[1, -1], [2, 0]]
