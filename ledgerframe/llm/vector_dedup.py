"""Embedding near-duplicates by tile products of int8 vectors with rigorous error bounds.

Equal vectors form a class, held by the smallest vec_id; a class counts with its size. Unit vectors x are quantised as x = s*q + e
with q of int8; |e| is measured, not assumed. For two vectors |x.y - s*s'*(q.q')| <= |e|*(1 + |e'|) + |e'|, so that a tile product
of integers (exact in float32: sums over EXACT dimensions stay below 2^24, and longer ones are added in double precision) finds all pairs that may reach the threshold; only they are computed again, in double
precision, from the original components. Vectors are dealt into tiles by their nearest pivot, and two pivots' tiles meet only if the
angle between the pivots is within both radii and the threshold's angle (triangle inequality), so that what can't hold a link is never
multiplied. A task holds a group of up to HELD tiles of one pivot and meets the other tiles one by one; each pair of tiles returns at most
one row per vector: its number of links there, and the root of its local component, not the pairs.

Vectors that are null, zero or hold null or non-finite components: n_links 0, their own component. Vectors of different lengths are
never linked. Null vec_id: returned with n_links 0 and a null component, kept. Repeated rows (one vec_id twice) count as two vectors.
Labels and extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table, wide
from .vectors import k_means, matrix, nearest, sample, usable

THRESHOLD, TILE, PIVOTS, FIT_ROWS, BLOCK = 0.95, 4096, 8, 4096, 1024
#: Tiles that a task holds at most, and bytes of vectors in a tile.
HELD, TILE_BYTES = 16, 4 << 20
#: Added to bounds for the rounding of float32 factors and of the measured norms.
SLACK = 1e-5
#: Dimensions whose products of two int8 digits add up to less than 2^24.
EXACT = (1 << 24) // (127 * 127)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows: unit vectors' int8 digits, scales, lengths of the errors, and the rows' norms."""
    norm = np.sqrt((x * x).sum(1))
    big = np.abs(x).max(1, initial=0)  # against overflow and underflow of squares
    odd = ~np.isfinite(norm) | (norm < 1e-150)
    if odd.any():
        norm[odd] = big[odd] * np.sqrt(((x[odd] / big[odd, None]) ** 2).sum(1))
    unit = x / norm[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1))
    return q, scale, error, norm


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components under edges a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of x, j of y) with cosine at least threshold, block by block; same: x is y, pairs i < j."""
    qx, sx, ex, nx = quantised(x)
    qy, sy, ey, ny = (qx, sx, ex, nx) if same else quantised(y)
    fx, fy = qx.astype(np.float32), qy.astype(np.float32)
    ux, uy = x / nx[:, None], y / ny[:, None]
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
            p = fx[a, :EXACT] @ fy[b, :EXACT].T
            for k in range(EXACT, fx.shape[1], EXACT):
                p = p + (fx[a, k : k + EXACT] @ fy[b, k : k + EXACT].T).astype(np.float64)
            p *= sx[a, None].astype(p.dtype)
            p *= sy[None, b].astype(p.dtype)
            slack = ex[a].max() * (1 + ey[b].max()) + ey[b].max() + SLACK
            k, m = np.nonzero(p >= threshold - slack)
            may = p[k, m] + ex[a][k] * (1 + ey[b][m]) + ey[b][m] + SLACK >= threshold
            k, m = k[may] + i, m[may] + j
            if same:
                k, m = k[k < m], m[k < m]
            for at in range(0, len(k), 100_000):
                kk, mm = k[at : at + 100_000], m[at : at + 100_000]
                xx, yy = x[kk], y[mm]
                with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                    cosine = (xx * yy).sum(1) / (nx[kk] * ny[mm])
                wrong = ~np.isfinite(cosine)
                cosine[wrong] = (ux[kk[wrong]] * uy[mm[wrong]]).sum(1)
                yield kk[cosine >= threshold], mm[cosine >= threshold]


def near_duplicates(vectors: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """id, n_links, component_id and kept of each row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_name).cast("long").alias("id"), F.col(vector_name).cast("array<double>").alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("id").isNotNull())
    classes = cut(rows.where("ok").groupBy("vector").agg(F.min("id").alias("holder"), F.count("*").alias("size")))
    fitted = sample(classes.select(F.col("holder").alias("id"), "vector"), "id", FIT_ROWS)
    if not len(fitted):
        out = rows.select(F.col("id").alias(id_name), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return out.withColumn("kept", F.lit(True))
    pivots = k_means(fitted / np.sqrt((fitted**2).sum(1, keepdims=True)), PIVOTS, 6)
    pivots /= np.maximum(np.sqrt((pivots**2).sum(1, keepdims=True)), 1e-12)
    d = pivots.shape[1]
    tile = max(min(tile, TILE_BYTES // (8 * d)), 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vector = b.column("vector")
            length = vector.value_lengths().to_numpy()
            pivot = -length.astype(np.int64)  # vectors of another length than the pivots': tiles of their own
            angle = np.zeros(len(length))
            own = np.flatnonzero(length == d)
            if len(own):
                x = matrix(vector.take(pa.array(own)))
                x = x / quantised(x)[3][:, None]
                pivot[own] = nearest(x, pivots)
                angle[own] = np.arccos(np.clip((x * pivots[pivot[own]]).sum(1), -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("holder"), b.column("size"), vector, pa.array(pivot), pa.array(angle)], ["holder", "size", "vector", "pivot", "angle"])

    at = cut(classes.mapInArrow(dealt, "holder long, size long, vector array<double>, pivot long, angle double"))
    # As many rows as pivots and other lengths come to the driver.
    groups = at.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    tiles = {g.pivot: -(-g.n // tile) for g in groups}
    # A task holds so many tiles of one pivot and meets the others one by one, so that a tile is sent once a group, not once a pair.
    held = min(max(sum(tiles.values()) // (2 * wide(vectors)), 1), HELD)
    reach = float(np.arccos(threshold)) + 1e-6
    meets: dict[int, list[int]] = {}  # of a pivot's tiles, the pivots whose groups they meet
    for a in groups:
        for b in groups:
            if a.pivot == b.pivot or 0 <= a.pivot < b.pivot and np.arccos(np.clip(pivots[a.pivot] @ pivots[b.pivot], -1, 1)) <= a.radius + b.radius + reach:
                meets.setdefault(b.pivot, []).append(a.pivot)
    by_pivot = lambda f: F.element_at(F.create_map(*(F.lit(x) for p in tiles for x in (p, f(p)))), F.col("pivot"))
    tiled = at.withColumn("tile", F.pmod(F.xxhash64("holder"), by_pivot(lambda p: tiles[p])))
    packed = cut(tiled.groupBy("pivot", "tile").agg(F.collect_list(F.struct("holder", "size", "vector")).alias("x")))  # about tile vectors each
    groups_of = spark.createDataFrame([(q, p, -(-tiles[p] // held)) for q, ps in meets.items() for p in ps], "pivot long, p long, n long")  # rows follow from the number of pivots
    left = packed.select(F.col("pivot").alias("p"), F.expr(f"tile div {held}").alias("g"), F.lit(0).alias("turn"), "pivot", "tile", "x")
    right = packed.join(F.broadcast(groups_of), "pivot").withColumn("g", F.explode(F.expr("sequence(0l, n - 1)"))).where(f"p <> pivot or g * {held} <= tile")
    met = left.unionByName(right.select("p", "g", F.lit(1).alias("turn"), "pivot", "tile", "x")).repartition(max(wide(vectors), sum(-(-n // held) for n in tiles.values())), "p", "g")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []  # a group, and its tiles: number, holders, sizes and vectors
        for b in batches:
            key = list(zip(*(b.column(c).to_pylist() for c in ("p", "g", "turn", "pivot", "tile"))))
            for k, (p, g, turn, pivot, number) in enumerate(key):
                if (p, g) != now:
                    now, own = (p, g), []
                s = b.column("x")[k].values
                one = (number, s.field("holder").to_numpy(), s.field("size").to_numpy(), matrix(s.field("vector")))
                if not turn:
                    own.append(one)
                    continue
                for other in own:
                    same = p == pivot and other[0] == number
                    if p == pivot and other[0] > number:
                        continue
                    ids, size = (one[1], one[2]) if same else (np.concatenate([other[1], one[1]]), np.concatenate([other[2], one[2]]))
                    found = np.zeros(len(ids), np.int64)
                    label = np.arange(len(ids))
                    for i, j in tile_links(one[3] if same else other[3], one[3], same, threshold):
                        j = j if same else j + len(other[1])
                        np.add.at(found, i, size[j])
                        np.add.at(found, j, size[i])
                        label = roots(len(ids), np.concatenate([i, np.arange(len(ids))]), np.concatenate([j, label]))
                    some = np.flatnonzero(found)
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(found[some]), pa.array(ids[label[some]])], ["a", "n", "b"])

    found = cut(met.sortWithinPartitions("p", "g", "turn", "pivot", "tile").mapInArrow(links, "a long, n long, b long"))
    label = cut(components(found.select("a", "b")))
    n = found.groupBy("a").agg(F.sum("n").alias("n"))
    held = classes.join(n, classes.holder == n.a, "left").join(label, classes.holder == label.node, "left")
    held = held.select("vector", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "holder").alias("component_id"))
    out = rows.withColumn("vector", F.expr("if(ok, vector, null)")).alias("r").join(held.alias("h"), F.col("r.vector") == F.col("h.vector"), "left")
    out = out.select(F.col("r.id").alias(id_name), F.coalesce("h.n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("h.component_id", "r.id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_name) == F.col("component_id"), F.lit(True)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
