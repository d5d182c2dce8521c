"""What the corpus operators share: table access, cutting lineage, connected components, chunks of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP, _ADAPTIVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for what all executors must see: spark.checkpoint.dir; a folder of this machine only where that is unset and all runs here."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folders.shared(spark))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, placed: bool = False) -> DataFrame:
    """Writes df to the folder that the cluster shares and returns what is read from there; its shuffle files are no longer needed and go.

    Rows pass to Python at most BATCH_ROWS and about BATCH_BYTES at a time, as whole texts are in them. placed: Spark still knows by what
    df was dealt out last, so that later groups by that aren't shuffled again; it forgets this of an adaptive plan.
    """
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in (_CLEANUP, _BATCH, _BYTES, _ADAPTIVE)}
    rows = int(before[_BATCH] or 0)
    conf.set(_CLEANUP, "true")
    conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    conf.set(_BYTES, f"{BATCH_BYTES}b")
    if placed:
        conf.set(_ADAPTIVE, "false")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: the settings are read when a plan is made
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def give_back() -> None:
    """At the end of a task: memory that this Python worker no longer uses goes back to the machine, as workers are kept."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def wide(df: DataFrame) -> int:
    """Tasks to give work whose cost isn't seen in the bytes that Spark would deal it out by."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def unplaced(name: str) -> Column:
    """The column (of long), as one by which Spark doesn't know rows to be placed: a join with it shuffles both sides, and so can split a hot key."""
    return F.col(name).bitwiseXOR(F.lit(0).cast("long")).alias(name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node on an edge, component its smallest node.

    Each round every node points to that of its neighbours and itself which comes first in an order, two such steps are taken at once and
    the edges are contracted. In the first round the order is by the columns ao and bo of a and b, if edges have them (so that stars
    whose middle comes first go at once), else and later it is random, so that the number of rounds is logarithmic. An edge's ends never
    meet in one task, and the smallest nodes are found by partial aggregation. Edges with a null end are left out. No edges: no rows.
    """
    own = {"ao", "bo"} <= set(edges.columns)
    order = lambda c, o: F.struct((F.col(o) if own else F.lit(0).cast("long")).alias("o"), F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    rest = edges.where("a is not null and b is not null and a <> b").select(order("a", "ao").alias("a"), order("b", "bo").alias("b"))
    rest = cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    none = rest.select(F.col("a.id").alias("node"), F.col("a.id").alias("component"))
    steps = []
    while not rest.isEmpty():
        both = rest.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a.id").alias("u"), F.least("m", "a").alias("p"))
        step = cut(first.alias("x").join(first.select(unplaced("u"), "p").alias("y"), F.col("x.p.id") == F.col("y.u")).select(F.col("x.u").alias("u"), F.col("y.p.id").alias("p")))
        steps.append(step)
        rest = rest.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        rest = rest.join(step.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(step.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        own = False
        rest = rest.select(order("pa", "").alias("a"), order("pb", "").alias("b"))
        rest = cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not steps:
        return none
    # A node that a round left without edges has its root; the others' roots are the next rounds'.
    label = steps[-1]
    for step in reversed(steps[:-1]):
        label = step.alias("s").join(label.alias("l"), F.col("s.p") == F.col("l.u"), "left").select("s.u", F.coalesce("l.p", "s.p").alias("p"))
    least = label.groupBy("p").agg(F.min("u").alias("component")).select(unplaced("p"), "component")
    # By node again, as all that use it join it so; a large component's nodes are together before.
    return label.join(least, "p").select(F.col("u").alias("node"), "component").repartition("node")


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of the column by, dealt anew into batches that hold whole groups: no larger than a batch and a group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(by).to_numpy()
        last = int(np.searchsorted(g, g[-1]))  # the first row of the last group
        if last:
            yield pa.concat_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        elif held and held[0].column(by)[0].as_py() == g[0]:
            held.append(b)
        else:
            if held:
                yield pa.concat_batches(held)
            held = [b]
    if held:
        yield pa.concat_batches(held)


def per_row(df: DataFrame, keep: list[str], column: str, rows: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """The columns keep of df, as they are, and what rows() makes of column's values: a tuple of schema's columns for each."""
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*rows(b.column(column).to_pylist()))) or [()] * len(fields)
            arrays = [b.column(k) for k in keep] + [pa.array(v, types[t]) for v, (_, t) in zip(made, fields)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *(n for n, _ in fields)])
        give_back()

    own = dict(df.dtypes)
    return df.select(*keep, column).mapInArrow(run, ", ".join([*(f"{k} {own[k]}" for k in keep), schema]))


def slices(texts: Iterable[str | None], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts (null: empty) as UTF-8 in runs of about size bytes, each with the number of its first; a longer text is alone."""
    held: list[bytes] = []
    n = first = 0
    for i, t in enumerate(texts):
        text = t.encode() if t else b""
        if held and n + len(text) > size:
            yield first, held
            held, n, first = [], 0, i
        held.append(text)
        n += len(text)
    if held:
        yield first, held
