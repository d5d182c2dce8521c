"""Nearest neighbours by an inverted file of coarse centroids with product-quantised residuals.

The centroids and codebooks are fitted on at most FIT_ROWS vectors, taken by the hash of their ids; every vector is indexed: it is
in the list of its nearest centroid, and its residual is coded by the nearest codeword in each of PARTS subspaces. A query probes the
PROBES lists with the largest inner product of query and centroid; asymmetric distance tables (query against codewords) give
each coded vector's approximate product. The RERANK best of a block of a list are computed exactly, in double precision, from the
original vectors; so is every other vector whose approximate product, plus the most that its own coding error can add, reaches the
best k + 1 of those, so that nothing in a probed list is lost to the codes. Lists are cut into blocks of about BLOCK vectors and their
queries into blocks of about ASKED by hashes, so that neither a hot list nor all queries of one are one task's; equal vectors
of a block are coded and ranked once, with their smallest ids. A pair of blocks gives at most k rows a query, and ranks are taken over those.

How many lists a query probes is measured when the index is fitted: as many as bring TARGET of the true neighbours within the fitted
rows, asked for up to TRIED of them by brute force. Isotropic vectors have no near centroid, so that most lists are probed there; near
copies need few. More lists would take fewer rows for the same recall, but each query goes to every list that it probes.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id; vectors of another
length than most are compared with queries of their length in lists of their own, exactly. Ties: the smaller id. Repeated rows are two
candidates; a query's own id is never its candidate. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import k_means, matrix, nearest, sample, usable

LISTS, PARTS, CODEWORDS, FIT_ROWS, BLOCK, ASKED, RERANK, TARGET, TRIED = 64, 16, 256, 16_384, 4096, 4096, 100, 0.96, 256


class Index:
    """Fitted centroids (lists) and codebooks of residuals (parts)."""

    def __init__(self, x: np.ndarray, lists: int = LISTS, parts: int = PARTS, codewords: int = CODEWORDS):
        self.d = x.shape[1]
        self.centres = k_means(x, lists, 8)
        residual = x - self.centres[nearest(x, self.centres)]
        self.bounds = np.linspace(0, self.d, min(parts, self.d) + 1).astype(int)
        self.books = [k_means(residual[:, a:b], codewords, 6) for a, b in zip(self.bounds, self.bounds[1:])]

    def codes(self, x: np.ndarray, at: int) -> np.ndarray:
        residual = x - self.centres[at]
        return np.stack([nearest(residual[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)], 1)

    def errors(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """The most that approximate() can be off by for each row of x and a query of length 1: what isn't coded, and rounding."""
        coded = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)
        rounding = np.linalg.norm(self.centres[at]) + np.sqrt(len(self.books)) * np.linalg.norm(coded, axis=1)
        return np.linalg.norm(x - self.centres[at] - coded, axis=1) + 1e-5 * rounding

    def enough(self, x: np.ndarray, k: int) -> int:
        """So many lists that queries from x find TARGET of their k nearest in x."""
        asked = np.unique(np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int))
        products = x[asked] @ x.T
        products[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return len(self.centres)
        best = np.argpartition(-products, k - 1, axis=1)[:, :k]
        place = np.argsort(self.probes(x[asked], len(self.centres)), axis=1, kind="stable")  # of each list in a query's order
        found = np.sort(np.take_along_axis(place, nearest(x, self.centres)[best], 1), axis=None)
        return int(found[math.ceil(TARGET * len(found)) - 1]) + 1

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :n]

    def approximate(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries and coded vectors of a list by tables of the queries' products with all codewords."""
        out = np.repeat((q @ self.centres[at]).astype(np.float32)[:, None], len(codes), 1)
        for k, (a, b, book) in enumerate(zip(self.bounds, self.bounds[1:], self.books)):
            out += (q[:, a:b] @ book.T).astype(np.float32)[:, codes[:, k]]
        return out


def _best(index: Index, at: int, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, ...]:
    """query, id and exact product of each query's k best in a block."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
    same = same.ravel()
    by = np.argsort(same, kind="stable")  # within a class by id
    start = np.concatenate([[0], np.cumsum(np.bincount(same, minlength=len(first)))])
    distinct = x[first]
    n = min(max(rerank, k + 1), len(first))  # one more than k, as a query's own vector may be among them
    found: list[tuple[np.ndarray, ...]] = []
    codes = index.codes(distinct, at) if at >= 0 and n < len(first) else None
    error = None if codes is None else index.errors(distinct, at, codes)
    longest = np.linalg.norm(distinct, axis=1).max(initial=0)
    for i in range(0, len(q), 256):
        qq = q[i : i + 256]
        size = np.linalg.norm(qq, axis=1)
        if codes is None:
            need, reach = np.arange(len(first)), np.True_
        else:
            near = index.approximate(qq, at, codes)
            some = np.argpartition(-near, n - 1, axis=1)[:, :n]
            exact = np.stack([distinct[c] @ v for c, v in zip(some, qq)])
            least = np.partition(exact, n - k - 1, axis=1)[:, n - k - 1]
            reach = ~(near + size[:, None] * error < least[:, None])
            need = np.flatnonzero(reach.any(0))
            reach = reach[:, need]
        products = np.where(reach, qq @ distinct[need].T, -np.inf)
        for j in range(len(qq)):
            # The matrix product may round otherwise than the sums below, which decide.
            cutoff = np.partition(products[j], len(need) - k - 1)[len(need) - k - 1] - 1e-12 * size[j] * longest if len(need) > k else -np.inf
            chosen = need[np.flatnonzero(products[j] >= cutoff)]
            score = (distinct[chosen] * qq[j]).sum(1)
            top = np.argsort(-score, kind="stable")
            rows_ = np.concatenate([by[start[c] : min(start[c] + k + 1, start[c + 1])] for c in chosen[top]])
            scores = np.repeat(score[top], [min(k + 1, start[c + 1] - start[c]) for c in chosen[top]])
            own = ids[rows_]
            keep = own != q_ids[i + j]
            own, scores = own[keep], scores[keep]
            last = np.lexsort((own, -scores))[:k]
            found.append((np.full(len(last), q_ids[i + j]), own[last], scores[last]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_name: str = "vec_id", vector_name: str = "embedding", probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, id and score of each query's k nearest of vectors by inner product, its own id left out."""
    form = lambda df: df.select(F.col(id_name).cast("long").alias("id"), F.col(vector_name).cast("array<double>").alias("vector")).where("id is not null").where(usable(F.col("vector")))
    rows, asked = form(vectors), form(queries)
    fitted = sample(rows, "id", FIT_ROWS)
    index = Index(fitted) if len(fitted) else None
    nothing = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_name), F.lit(0.0).alias("score")).where("false")
    if index is None:
        return nothing
    probes = index.enough(fitted, k) if probes is None else probes

    def listed(batches: Iterator[pa.RecordBatch], probed: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("vector").value_lengths().to_numpy()
            own, other = np.flatnonzero(length == index.d), np.flatnonzero(length != index.d)
            at, which = [-length[other].astype(np.int64)], [other]
            if len(own):
                x = matrix(b.column("vector").take(pa.array(own)))
                to = index.probes(x, probes) if probed else nearest(x, index.centres)[:, None]
                at.append(to.ravel())
                which.append(np.repeat(own, to.shape[1]))
            which = pa.array(np.concatenate(which))
            yield pa.RecordBatch.from_arrays([b.column("id").take(which), b.column("vector").take(which), pa.array(np.concatenate(at))], ["id", "vector", "list"])

    schema = "id long, vector array<double>, list long"
    entries = cut(rows.mapInArrow(lambda b: listed(b, False), schema))
    blocks = {r.list: -(-r.n // BLOCK) for r in entries.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row per list
    asks = asked.mapInArrow(lambda b: listed(b, True), schema).where(F.col("list").isin(list(blocks)))
    asked_blocks = {r.list: -(-r.n // ASKED) for r in asks.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row per list
    if not asked_blocks:
        return nothing
    of_list = lambda n: F.element_at(F.create_map(*(F.lit(x) for kv in n.items() for x in kv)), F.col("list"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), of_list(n) - 1))
    asks = asks.withColumn("asked", F.pmod(F.xxhash64("id", F.lit(1)), of_list(asked_blocks))).withColumn("block", every(blocks))
    entries = entries.where(F.col("list").isin(list(asked_blocks))).withColumn("block", F.pmod(F.xxhash64("id"), of_list(blocks))).withColumn("asked", every(asked_blocks))

    def best(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        made = _best(index, int(key[0]), q["id"].to_numpy(), np.stack(q["vector"]), x["id"].to_numpy(), np.stack(x["vector"]), k, rerank)
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), made)))

    found = entries.groupBy("list", "block", "asked").cogroup(asks.groupBy("list", "block", "asked")).applyInPandas(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_name), "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
