"""Exact top-k search with segment statistics at several resolutions.

A vector is cut into segments; of each, mean and standard deviation are kept. For two vectors cut
alike, the squared distance is at least the sum over segments of length * ((difference of means)^2 +
(difference of deviations)^2), and more segments give a closer bound. A candidate is compared by one
segment first, then by ever more, and drops out as soon as its bound is farther than the query's
k-th best so far; what is left is compared exactly.

Scores are inner products: d^2 = |q|^2 + |x|^2 - 2 score, so "farther than" is a bound on the score,
length * (mean * mean + deviation * deviation) summed over segments, below the k-th best score.

That k-th best so far comes from a bounded sample of the rows. It decides how much is compared
exactly, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import LARGEST, best, grid, matrix, packed, products, real, sampled, whole

#: Rows that give each query its first bound; rows and queries in a block, and queries compared at a time.
SAMPLE, BLOCK, QUERIES, SLICE = 2048, 4096, 2048, 64
#: Bounds are looser by this share of the vectors' lengths, as they are taken in double precision.
SLACK = 1e-9


def resolutions(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16 ... and the finest whose segments have two components or so."""
    out = [1]
    while out[-1] * 4 < dim // 2:
        out.append(out[-1] * 4)
    return out + [dim // 2] * (dim // 2 > out[-1])


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, times the root of its length."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]
    roots = [np.sqrt(p.shape[1]) for p in parts]
    return np.column_stack([p.mean(axis=1) * r for p, r in zip(parts, roots, strict=True)] + [p.std(axis=1) * r for p, r in zip(parts, roots, strict=True)]) if parts else np.zeros((len(x), 1))


def survivors(queries: np.ndarray, points: np.ndarray, least: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points that stay for any query, and for which ones. ``least``: the score that each query needs. ``counts`` gets the pairs that each resolution compares, and those compared exactly."""
    at, open_ = np.arange(len(points)), np.ones((len(queries), len(points)), dtype=bool)
    slack = SLACK * np.sqrt((queries * queries).sum(axis=1))[:, None] * np.sqrt((points * points).sum(axis=1)) + 1e-6
    for level, segments in enumerate(resolutions(queries.shape[1])):
        if counts is not None:
            counts[level] += open_.sum()
        bound = statistics(queries, segments) @ statistics(points[at], segments).T
        open_ &= ~(bound + slack[:, at] < least[:, None])
        some = open_.any(axis=0)
        at, open_ = at[some], open_[:, some]
    if counts is not None:
        counts[-1] += open_.sum()
    return at, open_


def nearest(vectors: DataFrame, query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest scores of each row that is a ``query`` among all other rows: query_id, rank (from 1), vec_id, score.

    A component x counts as floor(scale * x); a score is the integer inner product. Ties go by
    smaller id; where there are fewer rows, all are given. Rows without id or vector, or with a
    component that is null or not finite, take no part. Rows that repeat an id are rows of their own.
    A vector shorter than others counts as ending in zeros. Scores beyond 64 bits count as the
    outermost 64-bit numbers. Other columns aren't read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = written(grid(vectors, id_col, vector_col, scale, query=F.coalesce(query, F.lit(False))), "vectors")
    total, asked, dim = (x or 0 for x in rows.agg(F.count(F.lit(1)), F.count_if("query"), F.max(F.size("vec"))).first())
    sample = sampled(rows, total, SAMPLE)
    seeds = spark.sparkContext.broadcast((sample["row"].to_numpy(), matrix(sample["vec"], dim)))
    n_blocks, n_groups = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERIES))

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": df["block"].iloc[0]} | packed(rows=df["row"].to_numpy(), ids=df["id"].to_numpy(), vecs=matrix(df["vec"], dim))])

    def ask(df: pd.DataFrame) -> pd.DataFrame:
        vecs, own = matrix(df["vec"], dim), df["row"].to_numpy()
        order = np.lexsort(statistics(vecs, 1).T)  # queries alike go together
        vecs, own, least = vecs[order], own[order], np.full(len(own), -LARGEST)
        for s in range(0, len(own), SLICE):
            scores = products(vecs[s : s + SLICE], seeds.value[1])
            other = own[s : s + SLICE, None] != seeds.value[0]
            for r in np.flatnonzero(other.sum(axis=1) >= k):
                least[s + r] = np.partition(scores[r, other[r]], -k)[-k]
        return pd.DataFrame([{"group": df["group"].iloc[0]} | packed(rows=own, ids=df["id"].to_numpy()[order], least=least, vecs=vecs)])

    blocks = written(rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))).groupBy("block").applyInPandas(pack, "block long, rows binary, ids binary, vecs binary"), "blocks")
    asking = rows.where("query").withColumn("group", F.pmod(F.xxhash64("row", F.lit("group")), F.lit(n_groups)))
    queries = written(asking.groupBy("group").applyInPandas(ask, "group long, rows binary, ids binary, least binary, vecs binary"), "queries")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "query_id": [], "row": [], "vec_id": [], "score": []})]
        for q, b in ((q, b) for q in left.itertuples() for b in right.itertuples()):
            own, own_ids, least, asked_ = whole(q.rows), whole(q.ids), whole(q.least), real(q.vecs, dim)
            rows_, ids, points = whole(b.rows), whole(b.ids), real(b.vecs, dim)
            for s in (slice(s, s + SLICE) for s in range(0, len(own), SLICE)):
                at, open_ = survivors(asked_[s], points, least[s])
                scores = products(asked_[s], points[at])
                line, place = best(scores, ids[at], rows_[at], open_ & (scores >= least[s][:, None]) & (rows_[at] != own[s][:, None]), k)
                out.append(pd.DataFrame({"query": own[s][line], "query_id": own_ids[s][line], "row": rows_[at][place], "vec_id": ids[at][place], "score": scores[line, place]}))
        return pd.concat(out).astype("int64")

    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = queries.withColumn("block", F.explode(upto(n_blocks)))
    right = blocks.withColumn("group", F.explode(upto(n_groups)))
    found = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInPandas(search, "query long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
