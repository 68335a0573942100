"""Vectors on an integer grid: the rows that take part, packed blocks of them, and exact inner products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers below this are whole in double precision.
EXACT = 2**53
LARGEST = 2**63 - 1


def grid(vectors: DataFrame, id_col: str, vector_col: str, scale: float, **more: Column) -> DataFrame:
    """``id``, ``vec`` (as doubles, times ``scale``) and the columns ``more`` of all rows with an id and a vector of finite numbers; ``row`` tells equal rows apart."""
    vec = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale)
    made = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), *[c.alias(name) for name, c in more.items()])
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return made.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & sound).withColumn("row", F.monotonically_increasing_id())


def sampled(rows: DataFrame, total: int, most: int) -> pd.DataFrame:
    """At most ``most`` of ``total`` rows (row, vec), those first by a hash. A bound on the hash lets about twice as many through, so tasks send few rows whatever their number."""
    share = min(1.0, 2 * most / max(1, total))
    h = F.pmod(F.xxhash64("id", "row"), F.lit(1 << 30))
    found = rows.select("row", "vec", h.alias("h")).where(F.col("h") < int(share * (1 << 30))).orderBy("h", "row").limit(most).collect()
    return pd.DataFrame({"row": np.array([r["row"] for r in found], dtype=np.int64), "vec": pd.Series([r["vec"] for r in found], dtype=object)})


def matrix(vecs: pd.Series, dim: int) -> np.ndarray:
    """Vectors rounded down to whole numbers, a row each; shorter ones end in zeros."""
    if all(len(v) == dim for v in vecs):
        return np.floor(np.array(vecs.tolist(), dtype=np.float64).reshape(len(vecs), dim))
    out = np.zeros((len(vecs), dim))
    for k, v in enumerate(vecs):
        out[k, : len(v)] = np.floor(np.asarray(v, dtype=np.float64))
    return out


def packed(**columns: np.ndarray) -> dict[str, bytes]:
    """Numbers as bytes: whole numbers as 64-bit integers, others as doubles."""
    return {k: np.ascontiguousarray(v, dtype="<i8" if v.dtype.kind == "i" else "<f8").tobytes() for k, v in columns.items()}


def whole(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8")


def real(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as integers. Where doubles can't hold them exactly, Python's integers do; results beyond 64 bits become the outermost ones."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object)
    return np.clip(exact(a) @ exact(b).T, -LARGEST, LARGEST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and place of the ``k`` highest scores of each line among those in ``mask``; ties by smaller id, then row."""
    lines, places = [], []
    for r in np.flatnonzero(mask.any(axis=1)):
        at = np.flatnonzero(mask[r])
        if len(at) > k:
            s = scores[r, at]
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
        at = at[np.lexsort((rows[at], ids[at], -scores[r, at]))[:k]]
        lines.append(np.full(len(at), r))
        places.append(at)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *lines]), np.concatenate([none, *places])
