"""Near pairs in many dimensions against all pairs."""

import numpy as np
import pytest

from quarryline.operators import sequence
from quarryline.plans import queries

SF = "/root/testdata/sf0.01"


def test_recall_on_the_embeddings(spark):
    points = queries.shifted_points(spark, SF).toPandas()
    x, ids = np.array(points["v"].tolist()), points["vec_id"].to_numpy()
    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T))
    want = {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))): d[i, j] for i, j in zip(*np.nonzero(np.triu(d < 0.3, 1)), strict=True)}
    got = {(r.a, r.b): r for r in queries.QUERIES["s10_near_pairs"](spark, SF).collect()}
    assert len(want) >= 400 and got.keys() <= want.keys()
    assert len(got) >= 0.9 * len(want)
    assert all(got[k].distance == pytest.approx(want[k], abs=1e-6) and got[k].weight == pytest.approx(0.15 * (1 - want[k] / 0.3), abs=1e-6) for k in got)


def test_few_candidates_are_compared(spark):
    """Buckets hold a small part of all pairs."""
    points = queries.shifted_points(spark, SF)
    near = sequence.near_pairs(points, "vec_id", "v", 64, 0.3)
    wide = sequence.near_pairs(points, "vec_id", "v", 64, 0.3, tables=1, projections=1, width=1000.0)
    assert wide.count() >= near.count() >= 0.9 * wide.count()


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (None, [0.0, 1.0]), (7, [9.0, 9.0]), (8, [0.05, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, vec array<double>, a int, key string")
    got = {(r.a, r.b) for r in sequence.near_pairs(df, "id", "vec", 2, 0.3).collect()}
    assert got == {(1, 2), (1, 8), (2, 8)}
    assert sequence.near_pairs(df.limit(0), "id", "vec", 2, 0.3).count() == 0


def test_candidates_follow_the_pairs(spark):
    """Points that aren't near are hardly ever compared, however many there are; of pairs just within the distance next to none are missed."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    move = r.normal(size=(3000, 64))
    move *= 0.2999 / np.linalg.norm(move, axis=1)[:, None]
    rows = [(2 * k, v.tolist()) for k, v in enumerate(x)] + [(2 * k + 1, v.tolist()) for k, v in enumerate(x + move)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    reps = df.select(df.id.alias("c"), df.vec.alias("v"))
    assert sequence.near_candidates(reps, 64, 0.3).count() <= 20_000  # of 18 million pairs
    got = {(p.a, p.b) for p in sequence.near_pairs(df, "id", "vec", 64, 0.3).collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(3000)} and len(got) >= 2970


def test_many_copies(spark):
    """Copies of a vector are one point until the end."""
    df = spark.createDataFrame([(k, [float(k // 60), 0.5]) for k in range(180)] + [(900, [0.05, 0.5])], "id long, vec array<double>")
    got = [(p.a, p.b, round(p.distance, 9)) for p in sequence.near_pairs(df, "id", "vec", 2, 0.3).collect()]
    same = [(a, b, 0.0) for a in range(180) for b in range(a + 1, 180) if a // 60 == b // 60]
    assert sorted(got) == sorted(same + [(k, 900, 0.05) for k in range(60)])
