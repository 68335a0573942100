"""Exact metric range join of vectors: pivots partition them, and cells are joined independently.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Each vector lives
in the cell of its nearest pivot. It is also shown to every cell whose vectors may be within r: by
the triangle inequality its distance to that cell's pivot exceeds that to its own by 2r at most,
and its distance to the plane between the two pivots is r at most. A cell's own vectors then find
all partners among those shown to the cell. Within a cell, vectors lie in rings of width r around
its pivot, and again by the triangle inequality only equal and neighbouring rings are joined; large
rings are joined in blocks. Pivots decide how much work that is, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .components import components

#: Vectors for each pivot that is wanted, pivots of all labels at most (they go to every task), and rows in a block.
CELL, MOST_PIVOTS, BLOCK = 4000, 2048, 2048
#: Distances are taken from cosines, so small ones are true to 2e-8 or so; bounds are wider by this.
SLACK = 1e-6
#: Vectors, for each pivot, among which pivots are chosen.
DRAWN = 8


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((0, 1))


def _local(mask: np.ndarray, row_ids: np.ndarray, col_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id reached through ``mask`` for each row and column; every one has a link."""
    at = {i: k for k, i in enumerate(np.union1d(row_ids, col_ids))}
    r, c = (np.array([at[i] for i in ids]) for ids in (row_ids, col_ids))
    low = np.arange(len(at))
    most = len(at)
    while True:
        before = low.copy()
        np.minimum.at(low, r, np.array([np.where(m, low[c], most).min() for m in mask]))
        np.minimum.at(low, c, np.array([np.where(m, low[r], most).min() for m in mask.T]))
        low = low[low]
        if (low == before).all():
            names = np.array(list(at))
            return names[low[r]], names[low[c]]


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the unit vectors ``x``, each the farthest from those before it."""
    chosen, near = [0], 1 - x @ x[0]
    while len(chosen) < min(n, len(x)):
        k = int(near.argmax())
        if near[k] <= 1e-12:
            break
        chosen.append(k)
        near = np.minimum(near, 1 - x @ x[k])
    return x[chosen]


def _pivots(classes: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Pivots of each kind with more vectors than a cell should have: at most MOST_PIVOTS of all, far from each other among a hash's draw of its vectors."""
    cell = max(CELL, -(-2 * total // MOST_PIVOTS))
    # At most MOST_PIVOTS / 2 kinds are so large.
    sizes = classes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).withColumn("wanted", F.ceil(F.col("n") / cell))
    drawn = classes.join(F.broadcast(sizes), "kind").where(F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.expr(f"n DIV (wanted * {DRAWN})"))) == 0)

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        best = _spread(_unit(rows["vec"]), int(rows["wanted"].iloc[0]))
        return pd.DataFrame({"kind": rows["kind"].iloc[0], "vec": list(best)})

    found: dict[int, list] = {}
    for r in drawn.select("kind", "id", "wanted", "vec").groupBy("kind").applyInPandas(chosen, "kind long, vec array<double>").collect():
        found.setdefault(r["kind"], []).append(r["vec"])
    return {kind: np.array(rows) for kind, rows in found.items()}


def _shown(classes: DataFrame, radius: float, total: int) -> DataFrame:
    """Each vector once for every cell it is shown to, with its ring there and whether it is the cell's own."""
    pivots = classes.sparkSession.sparkContext.broadcast(_pivots(classes, total))

    def cells(batches):
        for df in batches:
            parts = []
            for kind, rows in df.groupby("kind"):
                p = pivots.value.get(kind)
                if p is None or len(p) < 2:
                    parts.append(rows[["kind", "id", "weight", "vec"]].assign(cell=0, ring=0, own=True))
                    continue
                x = _unit(rows["vec"])
                dots = x @ p.T
                own = dots.argmax(axis=1)
                mine = dots[np.arange(len(x)), own][:, None]
                apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[own]
                far = np.sqrt(np.maximum(0, 2 - 2 * dots))
                seen = (far <= far[np.arange(len(x)), own][:, None] + 2 * radius) & (mine - dots <= radius * apart + SLACK)
                seen[np.arange(len(x)), own] = True
                k, c = np.nonzero(seen)
                rings = np.floor(far[k, c] / (radius + SLACK)).astype(np.int64)
                parts.append(rows[["kind", "id", "weight", "vec"]].iloc[k].assign(cell=c, ring=rings, own=own[k] == c))
            if parts:
                yield pd.concat(parts)[["kind", "cell", "ring", "id", "weight", "vec", "own"]]

    return written(classes.select("kind", "id", "weight", "vec").mapInPandas(cells, "kind long, cell long, ring long, id long, weight long, vec array<double>, own boolean"), "cells")


def _near_rings(shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shown`` with rings only in cells larger than a block; and for each ring i with own vectors their number, that of all shown in i and its neighbours, and into how many blocks each is dealt."""
    cells = written(shown.groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("size"), F.count_if("own").alias("owned")).where("owned > 0").drop("owned"), "sizes")
    ringed = shown.join(cells, ["kind", "cell"]).withColumn("ring", F.when(F.col("size") <= BLOCK, 0).otherwise(F.col("ring"))).drop("size")
    counted = ringed.groupBy("kind", "cell", "ring").agg(F.count_if("own").alias("n_own"), F.count(F.lit(1)).alias("n"))
    around = counted.withColumn("i", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1))).withColumn("n_own", F.when(F.col("ring") == F.col("i"), F.col("n_own")).otherwise(0))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    near = around.groupBy("kind", "cell", "i").agg(F.sum("n_own").alias("n_own"), F.sum("n").alias("n_near")).where("n_own > 0")
    return ringed, written(near.withColumn("as", blocks("n_own")).withColumn("bs", blocks("n_near")), "near")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of the same label whose cosine, in double precision, is at least ``threshold`` (above 0).

    Returns a row for each vector: its id, ``n_links`` (other vectors linked directly),
    ``component_id`` (the smallest id reachable, itself included) and ``kept`` (id = component_id).
    Equal vectors of a label are joined once and weigh what they count. Vectors that are null, zero,
    empty, or hold nulls or values that aren't finite, and rows without label, link with nothing.
    Rows that repeat an id count as vectors of their own; a row without id links like any other, and
    its component has the smallest id of the rest, or null if there is none. Other columns aren't read. Vectors of
    different lengths don't link. An empty table gives an empty one.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    vec = F.col("__ql_vec")
    base = vectors.select(F.col(id_col).alias("__ql_id"), F.col(vector_col).cast("array<double>").alias("__ql_vec"), F.col(label_col).alias("__ql_label"))
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    base = base.withColumn("__ql_class", F.when(F.col("__ql_label").isNotNull() & F.coalesce(sound, F.lit(False)), F.xxhash64("__ql_label", F.size(vec), vec)))
    classes = base.where("__ql_class IS NOT NULL").groupBy("__ql_class").agg(F.min("__ql_id").alias("doc"), F.count(F.lit(1)).alias("weight"), F.first("__ql_vec").alias("vec"), F.first("__ql_label").alias("label"))
    classes = written(classes.withColumn("kind", F.xxhash64("label", F.size("vec"))).withColumnRenamed("__ql_class", "id").drop("label"), "classes")

    total = classes.count()
    shown = _shown(classes, radius, total)
    ringed, near = _near_rings(shown)
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit("deal")), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["kind", "cell", "i", "a", "b"]
    left = ringed.where("own").withColumnRenamed("ring", "i").join(near, ["kind", "cell", "i"]).withColumn("a", deal("as")).select("kind", "cell", "i", "a", upto("bs").alias("b"), "id", "weight", "vec", F.lit(True).alias("left"))
    right = ringed.withColumn("i", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1))).join(near, ["kind", "cell", "i"]).withColumn("b", deal("bs")).select("kind", "cell", "i", upto("as").alias("a"), "b", "id", "weight", "vec", F.lit(False).alias("left"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["left"]], rows[~rows["left"]]
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"id": ids_a[:0], "n": ids_a[:0], "root": ids_a[:0]})
        mask = (_unit(a["vec"]) @ _unit(b["vec"]).T >= threshold) & (ids_a[:, None] != ids_b[None, :])
        n = mask @ b["weight"].to_numpy()
        rows_on, cols_on = mask.any(axis=1), mask.any(axis=0)
        if not rows_on.any():
            return pd.DataFrame({"id": ids_a[:0], "n": ids_a[:0], "root": ids_a[:0]})
        ra, rb = _local(mask[rows_on][:, cols_on], ids_a[rows_on], ids_b[cols_on])
        return pd.DataFrame({"id": np.concatenate([ids_a[rows_on], ids_b[cols_on]]), "n": np.concatenate([n[rows_on], np.zeros(len(rb), dtype=np.int64)]), "root": np.concatenate([ra, rb])})

    found = written(left.unionByName(right).groupBy(*key).applyInPandas(block, "id long, n long, root long"), "linked")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    released(shown, near)
    reach = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    rooted = classes.select("id", "doc", "weight").join(linked, "id", "left").join(reach, "id", "left").withColumn("root", F.coalesce("component", "id"))
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("smallest"))
    by_class = rooted.join(smallest, "root").select(F.col("id").alias("__ql_class"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "smallest")
    out = base.select("__ql_id", "__ql_class").join(by_class, "__ql_class", "left")
    out = out.select(F.col("__ql_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("__ql_class").isNull(), F.col("__ql_id")).otherwise(F.col("smallest")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
