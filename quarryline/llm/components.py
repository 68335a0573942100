"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, for every id in ``edges`` (columns a and b, of one type).

    Each round links every vertex's larger neighbours, then its smaller ones, to the smallest vertex
    among them, until nothing changes; that takes a number of rounds logarithmic in the longest
    path. Rounds are written to the shared folder. Edges with a null, and loops, are left out; an
    empty table gives an empty one.
    """
    both_known = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = written(both_known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if found == state or not found[0]:
            break
        state = found
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        released(now)
        now = after
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
