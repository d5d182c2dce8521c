"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Tokens are runs of word bytes or of punctuation bytes; features are tokens and pairs of neighbours (1- and 2-grams), hashed to
BUCKETS. The target model counts them in documents labelled good (at most FIT_ROWS labelled rows, taken by the hash of their id: a
documented bound of the fit), the raw model in all documents. Both are generative models of a bag of n-grams; each gets the same
prior, SMOOTH occurrences of every bucket at the target's size, so that what is too rare to tell has a ratio near 1. A document's weight
is the logarithm of the ratio of its probabilities under both, that is the sum over its features of their log ratios. A standard
Gumbel variate made from the seed and the doc_id is added, and the k documents with the largest sums are kept: a sample without
replacement in proportion to the ratio. k is a stated budget: a share of the documents with text, which is, unless it is given, the share
of good ones among the labelled rows. The k-th sum is found by counting sums in ever smaller intervals.

Map-only passes over documents; a task sends one row for 2048 buckets, and the labelled ids, bounded as they are, are broadcast. Null or
empty text: no features, and such a document is rejected (kept false, weight null). Null doc_id: as id -1 for the variate. Ties of a
sum: smaller doc_id first (null last); repeated rows are decided alike. Without a labelled good row that has text all documents with text
are kept. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, slices, table
from .hashing import joined, mix, word_hashes

BUCKETS, FIT_ROWS, SMOOTH, SEED = 1 << 16, 20_000, 10.0, 17
#: Intervals counted at once, and documents that are ordered one by one in the last.
CELLS, SALTS = 4096, 256
#: Bytes of text that a task works on at once.
SLICE = 1 << 20
_CLASS = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.int8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features and the text each is from, in no particular order."""
    data, starts = joined(texts)
    c = np.zeros(len(data) + 2, np.int8)
    c[1:-1] = _CLASS[data]
    change = np.flatnonzero(c[1:] != c[:-1])
    s, e = change[:-1], change[1:]
    keep = c[s + 1] > 0
    s, e = s[keep], e[keep]
    h = word_hashes(data, s, e)
    doc = np.searchsorted(starts, s, "right") - 1
    m = max(len(h) - 1, 0)
    near = doc[:m] == doc[1:]
    pair = mix(h[:m] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[near]
    buckets = np.concatenate([h, pair]) & np.uint64(BUCKETS - 1)
    return buckets.astype(np.int64), np.concatenate([doc, doc[:m][near]])


def counts(docs: DataFrame, at_once: int = 1 << 11) -> np.ndarray:
    """How often each bucket occurs in all texts: each task sends a row for at_once buckets, and so many rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column("text").to_pylist(), SLICE):
                total += np.bincount(features(texts)[0], minlength=BUCKETS)
        parts = total.reshape(-1, at_once)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "n"])
        give_back()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(at_once, np.int64)
        for n in rows["n"]:
            total += np.frombuffer(n, np.int64)
        return pd.DataFrame({"part": rows["part"][:1], "n": [total.tobytes()]})

    told = docs.select("text").mapInArrow(run, "part long, n binary")
    # Tasks' rows are added in two steps, so that no group grows with the number of tasks as a whole.
    told = told.groupBy("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).applyInPandas(added, "part long, n binary")
    out = np.zeros((BUCKETS // at_once, at_once))
    for r in told.groupBy("part").applyInPandas(added, "part long, n binary").collect():
        out[r.part] = np.frombuffer(r.n, np.int64)
    return out.ravel()


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """By bucket, the log ratio of both models' probabilities; both have the prior SMOOTH at the target's size."""
    scaled = raw * (target.sum() / max(raw.sum(), 1))
    return np.log(target + SMOOTH) - np.log(scaled + SMOOTH)


def weights(texts: list[bytes], ratio: np.ndarray) -> np.ndarray:
    """Each text's log importance weight, the sum of its features' log ratios; nan for a text without features."""
    buckets, doc = features(texts)
    n = np.bincount(doc, minlength=len(texts))
    return np.where(n, np.bincount(doc, ratio[buckets], minlength=len(texts)), np.nan)


def scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id and weight (null: no features) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [weights(texts, ratio) for _, texts in slices(batch.column("text").to_pylist(), SLICE)]
            w = np.concatenate(w) if w else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w, mask=np.isnan(w))], ["doc_id", "weight"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, weight double")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Log ratios by bucket, and the share of good ones among the labelled rows with text (1 if none is good)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = cut(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").where("text rlike '[^ \\t-\\r]'"))  # at most rows rows are broadcast
    good, n = labelled.agg(F.count_if(F.col("quality") == 1), F.count("*")).first()
    return log_ratio(counts(labelled.where("quality = 1")), counts(docs)), good / n if good else 1.0


def gumbel(seed: Column, doc_id: Column) -> Column:
    """A standard Gumbel variate by the hash of seed and doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64(seed, F.coalesce(doc_id.cast("long"), F.lit(-1).cast("long"))), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _last(rows: DataFrame, k: int) -> tuple[float, int | None]:
    """gumbel_key and doc_id of the k-th of rows, 1 <= k <= their number: largest key first, ties by doc_id, null last."""
    low, high = rows.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    while True:
        inside = rows.where(F.col("gumbel_key").between(low, high))
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit(CELLS - 1)) if width > 0 else F.lit(0)
        # At most CELLS rows.
        cells = inside.groupBy(cell.cast("long").alias("c")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("low"), F.max("gumbel_key").alias("high")).orderBy(F.desc("c")).collect()
        for c in cells:
            if c.n >= k:
                break
            k -= c.n
        if c.n <= CELLS or c.low == c.high:
            break
        low, high = c.low, c.high
    # Few rows, or those of one key, which are one document's copies.
    each = rows.where(F.col("gumbel_key").between(c.low, c.high)).groupBy("gumbel_key", "doc_id").agg(F.count("*").alias("n"))
    for r in each.orderBy(F.desc("gumbel_key"), F.asc_nulls_last("doc_id")).toLocalIterator():
        if r.n >= k:
            return r.gumbel_key, r.doc_id
        k -= r.n
    raise ValueError("k is more than there are rows")


def resample(docs: DataFrame, ratio: np.ndarray, share: float, seed: int = SEED) -> DataFrame:
    """doc_id, weight, gumbel_key and kept of each row; share: of the rows with text, how many are kept."""
    rows = cut(scored(docs, ratio).withColumn("gumbel_key", F.col("weight") + gumbel(F.lit(seed), F.col("doc_id"))))
    of = rows.where("gumbel_key is not null")
    k = round(share * of.count())
    if not k:
        return rows.withColumn("kept", F.lit(False))
    key, doc_id = _last(of, k)
    inside = (F.col("gumbel_key") > key) | (F.col("gumbel_key") == key) & (F.col("doc_id") <= doc_id if doc_id is not None else F.lit(True))
    return rows.withColumn("kept", F.coalesce(inside, F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """resample() by the models that fit() makes; share: the budget, that of good labels if None."""
    ratio, good = fit(docs, labels)
    return resample(docs, ratio, good if share is None else share)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
