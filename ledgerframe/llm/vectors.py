"""What both vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that aren't null or zero and hold no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(lists) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    column = lists if isinstance(lists, (pa.Array, pa.ChunkedArray)) else pa.array(lists)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sample(vectors: DataFrame, id_name: str, rows: int) -> np.ndarray:
    """At most rows vectors of the most common length, taken by the hash of their ids; sorted so, the same for the same table."""
    size = F.size("vector")
    common = vectors.groupBy(size.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return np.zeros((0, 1))
    return matrix(vectors.where(size == common.d).orderBy(F.xxhash64(id_name), id_name).select("vector").limit(rows).toArrow()["vector"])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centre."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int = 17) -> np.ndarray:
    """At most k centres of the rows of x by Lloyd's rounds from seeded rows."""
    x = x.astype(np.float32)
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        order = np.argsort(at, kind="stable")
        some, first = np.unique(at[order], return_index=True)
        centres[some] = np.add.reduceat(x[order], first, axis=0) / np.diff([*first, len(x)])[:, None]
    return centres.astype(np.float64)
