"""Hard negatives by a multiway hyperplane tree over vectors, with exact leaves.

Each node of the tree has several split points. A vector goes to the nearest one, so the planes
between split points part the space. A node keeps, for each pair of split points, the smallest and
largest distance from the one to the vectors below the other. A search wants all vectors whose
distance from the anchor lies in a window; by the triangle inequality those below a split point lie
in an annulus around each of its siblings, and a subtree whose stored range misses one of these
annuli holds none of them. Leaves that remain are searched exactly.

Scores are inner products. With one more component, sqrt(most - |x|^2), all vectors are equally long,
and a window of scores is a window of distances: d^2 = |a|^2 + most - 2 score.

Split points come from a bounded sample of the rows; every row is in the tree, and stored ranges are
taken over all rows. Split points decide how much work there is, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import LARGEST, best, grid, matrix, packed, products, real, sampled, whole

#: Rows from which split points are chosen; split points of a node; rows wanted in a leaf, and at least so that leaves are in the thousands.
SAMPLE, ARITY, LEAF, LEAVES = 8192, 8, 64, 1024
#: Rows in a block of leaves, blocks whose anchors go together, and anchors that are scored at a time.
BLOCK, SPAN, SLICE = 4096, 16, 256
#: Bounds are wider by this share of the longest vector, as distances are taken in double precision.
SLACK = 1e-6


class Tree:
    """Split points, children (nodes from 0, leaf k as -1 - k), and the ranges once they are counted."""

    def __init__(self, sample: np.ndarray, most: float, total: int):
        self.most, self.points, self.children, self.spans, self.leaves, self.ranges = most, [], [], [], 0, {}
        wanted = max(LEAF, -(-total // LEAVES)) * len(sample) / max(1, total)
        self.root = self._grow(self.lifted(sample), max(1.0, wanted))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))])

    def _grow(self, x: np.ndarray, wanted: float) -> int:
        points = _spread(x, ARITY) if len(x) > wanted else x[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        near = _distances(x, points).argmin(axis=1)
        k = len(self.points)
        self.points.append(points)
        self.children.append([])
        self.spans.append([])
        for j in range(len(points)):
            first = self.leaves
            self.children[k].append(self._grow(x[near == j], wanted))
            self.spans[k].append((first, self.leaves - 1))
        return k

    def place(self, x: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each vector; ``seen(node, distances, nearest)`` is told of every step."""
        at, lifted = np.full(len(x), self.root), self.lifted(x)
        while (at >= 0).any():
            for k in np.unique(at[at >= 0]):
                rows = np.flatnonzero(at == k)
                d = _distances(lifted[rows], self.points[k])
                near = d.argmin(axis=1)
                if seen:
                    seen(k, d, near)
                at[rows] = np.array(self.children[k])[near]
        return -1 - at

    def visits(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, first: int = 0, last: int = 2**62) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf from ``first`` to ``last`` that may hold a vector whose score with an anchor is in one of the anchor's windows, and which anchors. ``low`` and ``high``: a line for each anchor, a column for each window; a window with low > high holds nothing."""
        norms = (anchors * anchors).sum(axis=1)[:, None] + self.most
        slack = SLACK * np.sqrt(self.most) + 1e-9
        near, far = (np.sqrt(np.maximum(0, norms - 2 * s.astype(np.float64)))[:, :, None] for s in (high, low))
        point = np.column_stack([anchors, np.zeros(len(anchors))])
        todo = [(self.root, low <= high)]
        while todo:
            k, open_ = todo.pop()
            if k < 0:
                yield -1 - k, open_.any(axis=1)
            elif k in self.ranges:
                away = _distances(point, self.points[k])[:, None, :]
                inner, outer = np.maximum(away - far, near - away) - slack, away + far + slack
                lo, hi = self.ranges[k]
                for j, child in enumerate(self.children[k]):
                    if self.spans[k][j][0] <= last and self.spans[k][j][1] >= first:
                        still = open_ & ~((lo[:, j] > outer) | (hi[:, j] < inner)).any(axis=2)
                        if still.any():
                            todo.append((child, still))


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows, each the farthest from those before it."""
    chosen = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(chosen) < n and near.max() > SLACK * np.abs(x).max():
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _planted(rows: DataFrame) -> tuple[Tree, int]:
    """The tree and the length of the longest vector."""
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.floor(x).cast("double") * F.floor(x).cast("double"))
    total, most, dim = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("vec"))).first()
    return Tree(matrix(sampled(rows, total, SAMPLE)["vec"], dim or 0), most or 0.0, total), dim or 0


def _blocks(rows: DataFrame, tree: Tree, dim: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Rows packed in blocks, and each leaf's first block and number of blocks. A block has several small leaves, or part of a large one. The tree gets its ranges, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield df.assign(leaf=shared.value.place(matrix(df["vec"], dim)))

    def ranged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list] = {}

        def seen(k, d, near):
            for j in np.unique(near):
                below = d[near == j]
                for i, (lo, hi) in enumerate(zip(below.min(axis=0), below.max(axis=0), strict=True)):
                    x = found.setdefault((k, i, j), [lo, hi])
                    x[:] = min(x[0], lo), max(x[1], hi)

        for df in frames:
            shared.value.place(matrix(df["vec"], dim), seen)
        yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["node", "i", "j", "lo", "hi"])

    leafed = written(rows.mapInPandas(placed, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, leaf long"), "leafed")
    # As many numbers as the tree has pairs of siblings.
    for r in leafed.select("vec").mapInPandas(ranged, "node long, i long, j long, lo double, hi double").groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        m = len(tree.points[r["node"]])
        lo, hi = tree.ranges.setdefault(r["node"], (np.full((m, m), np.inf), np.full((m, m), -np.inf)))
        lo[r["i"], r["j"]], hi[r["i"], r["j"]] = r["lo"], r["hi"]
    where, n, room = {}, -1, 0
    for leaf, count in sorted((r["leaf"], r["count"]) for r in leafed.groupBy("leaf").count().collect()):
        if count > room:
            parts = -(-count // BLOCK)
            where[leaf] = (n + 1, parts)
            n, room = n + parts, BLOCK - count if parts == 1 else 0
        else:
            where[leaf] = (n, 1)
            room -= count
    places = rows.sparkSession.createDataFrame([(leaf, *x) for leaf, x in where.items()], "leaf long, first long, parts long")
    dealt = leafed.join(F.broadcast(places), "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["leaf", "id", "row"])
        return pd.DataFrame([{"block": df["block"].iloc[0]} | packed(leaves=df["leaf"].to_numpy(), rows=df["row"].to_numpy(), ids=df["id"].to_numpy(), labels=df["label"].to_numpy(), marks=df["anchor"].to_numpy().astype(np.int64), vecs=matrix(df["vec"], dim))])

    return written(dealt.groupBy("block").applyInPandas(pack, "block long, leaves binary, rows binary, ids binary, labels binary, marks binary, vecs binary"), "blocks"), where


def _anchors(blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """The anchors, each with a window that holds its ``k`` best positives: from the k-th best in its own block up."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for b in df.itertuples():
                ids, labels, rows, vecs = whole(b.ids), whole(b.labels), whole(b.rows), real(b.vecs, dim)
                at = np.flatnonzero(whole(b.marks))
                if not len(at):
                    continue
                low = np.full(len(at), -LARGEST)
                for s in range(0, len(at), SLICE):
                    q = at[s : s + SLICE]
                    scores = products(vecs[q], vecs)
                    fit = (labels[q][:, None] == labels) & (rows[q][:, None] != rows)
                    for r in np.flatnonzero(fit.sum(axis=1) >= k):
                        low[s + r] = np.partition(scores[r, fit[r]], -k)[-k]
                yield pd.DataFrame({"row": rows[at], "id": ids[at], "label": labels[at], "vec": list(vecs[at]), "group": b.block // SPAN, "low": [[x] for x in low], "high": [[LARGEST]] * len(at)})

    return written(blocks.mapInPandas(run, "row long, id long, label long, vec array<double>, group long, low array<long>, high array<long>"), "bounded")


def _searched(anchors: DataFrame, blocks: DataFrame, where: dict[int, tuple[int, int]], tree: Tree, dim: int, k: int, same: bool) -> DataFrame:
    """For each window of each anchor the ``k`` best rows in it, of the anchor's own label or of others: anchor (its row), window, id, score and rank."""
    shared = anchors.sparkSession.sparkContext.broadcast((tree, where))

    def slices(n: int) -> Iterator[slice]:
        return (slice(s, s + SLICE) for s in range(0, n, SLICE))

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        low, high = (np.array(df[c].tolist(), dtype=np.int64) for c in ("low", "high"))
        vecs, reach = matrix(df["vec"], dim), set()
        for s in slices(len(df)):
            for leaf, _ in shared.value[0].visits(vecs[s], low[s], high[s]):
                first, parts = shared.value[1].get(leaf, (0, 0))
                reach.update(range(first, first + parts))
        return pd.DataFrame([{"group": df["group"].iloc[0], "reach": sorted(reach)} | packed(rows=df["row"].to_numpy(), labels=df["label"].to_numpy(), vecs=vecs, low=low, high=high)])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "window": [], "row": [], "id": [], "score": []})]
        for a, b in ((a, b) for a in left.itertuples() for b in right.itertuples()):
            own, own_labels, anchors_ = whole(a.rows), whole(a.labels), real(a.vecs, dim)
            low, high = (whole(x).reshape(len(own), -1) for x in (a.low, a.high))
            leaves, rows, ids, labels, points = whole(b.leaves), whole(b.rows), whole(b.ids), whole(b.labels), real(b.vecs, dim)
            for s in slices(len(own)):
                open_ = np.zeros((len(own[s]), len(rows)), dtype=bool)
                for leaf, wanted in shared.value[0].visits(anchors_[s], low[s], high[s], leaves[0], leaves[-1]):
                    open_[:, slice(*np.searchsorted(leaves, [leaf, leaf + 1]))] = wanted[:, None]
                at = np.flatnonzero(open_.any(axis=0))
                fit = open_[:, at] & (rows[at] != own[s][:, None]) & ((labels[at] == own_labels[s][:, None]) == same)
                scores = products(anchors_[s], points[at])
                for w in range(low.shape[1]):
                    line, place = best(scores, ids[at], rows[at], fit & (scores >= low[s, w : w + 1]) & (scores <= high[s, w : w + 1]), k)
                    out.append(pd.DataFrame({"anchor": own[s][line], "window": w, "row": rows[at][place], "id": ids[at][place], "score": scores[line, place]}))
        return pd.concat(out).astype("int64")

    sent = written(anchors.groupBy("group").applyInPandas(pack, "group long, reach array<long>, rows binary, labels binary, vecs binary, low binary, high binary"), "anchors")
    left = sent.select("group", F.explode("reach").alias("block"), "rows", "labels", "vecs", "low", "high")
    right = blocks.join(sent.select(F.col("group").alias("to"), F.explode("reach").alias("block")), "block").withColumnRenamed("block", "at")
    found = left.groupBy("group", "block").cogroup(right.groupBy("to", "at")).applyInPandas(search, "anchor long, window long, row long, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("row")


def mine(vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    A component x counts as floor(scale * x); a score is the integer inner product. Higher scores
    come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of
    the same ``label``; for each, the first ``negatives`` rows of other labels are given whose score
    is at most the positive's and at least ``percent`` percent of it. Returns anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score and positive_rank. Where there are
    fewer rows, all are given; an anchor without a positive, and a positive whose window is empty
    (always so below a score of 0), have none.

    Rows without id, label or vector, or with a component that is null or not finite, take no part.
    Rows that repeat an id are rows of their own, as positives, negatives and anchors. A vector
    shorter than others counts as ending in zeros. Scores beyond 64 bits count as the outermost
    64-bit numbers. Other columns aren't read; an empty table gives an empty one.
    """
    rows = grid(vectors, id_col, vector_col, scale, label=F.when(label.isNotNull(), F.xxhash64(label)), anchor=F.coalesce(anchor, F.lit(False)))
    rows = written(rows.where("label IS NOT NULL"), "vectors")
    tree, dim = _planted(rows)
    blocks, where = _blocks(rows, tree, dim)
    anchors = _anchors(blocks, dim, positives)
    near = written(_searched(anchors, blocks, where, tree, dim, positives, True).select("anchor", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.ceil(F.col("positive_score").cast("decimal(20,0)") * percent / 100).cast("long")
    window = F.struct("positive_rank", least.alias("low"), F.col("positive_score").alias("high"))
    windows = near.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(window)).alias("w"))  # as many as there are positives
    shut = lambda c, v: F.concat(F.col(f"w.{c}"), F.array_repeat(F.lit(v).cast("long"), F.lit(positives) - F.size("w"))).alias(c)
    again = anchors.drop("low", "high").join(windows, "row").select("row", "id", "label", "vec", "group", shut("low", 1), shut("high", 0))
    far = _searched(again, blocks, where, tree, dim, negatives, False).withColumn("positive_rank", (F.col("window") + 1).cast("int")).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    found = far.join(near, ["anchor", "positive_rank"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
