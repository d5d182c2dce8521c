"""Ports: delivery of micro-batches to a function, at most, at least or exactly once; regions route requests to programs; queues."""

from __future__ import annotations

import importlib.util
import logging
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import codec, folders

Work = Callable[[DataFrame], None]
Program = Callable[[DataFrame], DataFrame]
#: Conditions and their response codes.
RESPONSES = {"NORMAL": 0, "FILENOTFOUND": 12, "NOTFND": 13, "QIDERR": 44, "TRANSIDERR": 28, "PGMIDERR": 27, "DBNOTFOUND": 13}


shared_folder = folders.shared


class Port:
    """A durable first-in-first-out queue of batches of records in a folder that all see, with receive, commit and rollback.

    A batch is there once its folder has its name, and gone once it is renamed, so that neither a sender nor a receiver that ends early
    leaves half of one. One receiver at a time; several senders may send.
    """

    def __init__(self, spark: SparkSession, folder: str, encoding: str | None = None, text: str = "text"):
        self.spark, self.folder, self.encoding, self.text, self.taken = spark, folder, encoding, text, None
        folders.make(spark, folder)

    def waiting(self) -> list[str]:
        return [n for n in folders.children(self.spark, self.folder) if n.startswith("batch-")]

    def send(self, df: DataFrame) -> str:
        """Adds a batch behind all others; with an encoding its text goes as bytes of that code page."""
        if self.encoding:
            df = df.withColumn(self.text, on_wire(F.col(self.text), self.encoding))
        held = f"{self.folder}/.{uuid.uuid4().hex}"
        df.write.parquet(held)
        while True:
            used = [int(n.split("-")[1]) for n in folders.children(self.spark, self.folder) if n.startswith(("batch-", "done-"))]
            name = f"batch-{max(used, default=0) + 1:012}"
            if folders.rename(self.spark, held, f"{self.folder}/{name}"):
                return name

    def receive(self, timeout: float = 0.0, pause: float = 0.1) -> DataFrame | None:
        """The oldest batch, or None if none comes within so many seconds; it stays until commit()."""
        until = time.monotonic() + timeout
        while not (names := self.waiting()):
            if time.monotonic() >= until:
                return None
            time.sleep(pause)
        self.taken = names[0]
        df = self.spark.read.parquet(f"{self.folder}/{self.taken}")
        return df.withColumn(self.text, off_wire(F.col(self.text), self.encoding)) if self.encoding else df

    def commit(self) -> None:
        """ACK: the batch that was received last is done."""
        if self.taken:
            folders.rename(self.spark, f"{self.folder}/{self.taken}", f"{self.folder}/done-{self.taken.split('-')[1]}")
        self.taken = None

    ack = commit

    def rollback(self) -> None:
        """The batch that was received last will be received again."""
        self.taken = None

    def work(self, process: Callable[[DataFrame], None], mode: str = "at least once", retries: int = 3, pause: float = 1.0) -> int:
        """Receives, processes and commits batch by batch until none waits; the number of batches that were done.

        A batch that fails is lost with 'fire and forget', else it is rolled back and, with 'at least once', tried again.
        """
        done = 0
        while (df := self.receive()) is not None:
            for attempt in range(1 + (retries if mode == "at least once" else 0)):
                try:
                    process(df)
                    break
                except Exception:
                    if mode == "fire and forget":
                        logging.getLogger(__name__).warning("a batch was lost", exc_info=True)
                        break
                    if attempt == (retries if mode == "at least once" else 0):
                        self.rollback()
                        raise
                    time.sleep(pause)
            self.commit()
            done += 1
        return done

    def close(self) -> None:
        self.rollback()


def listen(stream: DataFrame, work: Work, checkpoint: str, mode: str = "at least once", retries: int = 3, pause: float = 1.0, **trigger) -> StreamingQuery:
    """Starts delivering a stream's batches to a function.

    'fire and forget' logs errors and goes on; 'at least once' tries a batch again, so many times, and then fails, so that the next start
    delivers it once more; 'exactly once' sets a mark beside the checkpoint when a batch is done and passes over batches with one, also after
    a restart. A driver that ends between the work and its mark delivers that batch again: for a sink whose result is exactly once even
    then see delivered().
    """
    spark = stream.sparkSession

    def deliver(batch: DataFrame, number: int) -> None:
        mark = f"{checkpoint}-done/{number}"
        if mode == "exactly once" and folders.exists(spark, mark):
            return
        for attempt in range(1 + (retries if mode == "at least once" else 0)):
            try:
                work(batch)
                break
            except Exception:
                if mode == "fire and forget":
                    logging.getLogger(__name__).warning("a batch was lost", exc_info=True)
                    break
                if mode != "at least once" or attempt == retries:
                    raise
                time.sleep(pause)
        if mode == "exactly once":
            folders.touch(spark, mark)

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def delivered(stream: DataFrame, process: Program, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Exactly once: receive, process and commit as one. A batch's result replaces what an earlier try of it left in its own folder."""

    def commit(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def on_wire(text: Column, encoding: str = "cp037") -> Column:
    return codec.to_bytes(text, encoding)


def off_wire(data: Column, encoding: str = "cp037") -> Column:
    return codec.to_text(data, encoding)


_HELD = T.StructType([T.StructField("queue", T.StringType()), T.StructField("item", T.LongType()), T.StructField("data", T.StringType()), T.StructField("batch", T.LongType())])


class Region:
    """Transactions by name: each request (trans_id, commarea) goes to its program, a function of DataFrames; resources by name."""

    def __init__(self) -> None:
        self.transactions: dict[str, Program] = {}
        self.programs: dict[str, Program] = {}
        self.resources: dict[str, DataFrame] = {}
        self.tables: dict[str, Callable[[], DataFrame]] = {}
        self.rules: dict[str, Callable[[Column], Column]] = {}
        self.deployed: dict[str, float] = {}

    def rule(self, transaction: str, change: Callable[[Column], Column]) -> None:
        """A transaction that only changes the commarea: all such transactions are one pass over the requests."""
        self.rules[transaction] = change

    def deploy(self, folder: str) -> list[str]:
        """Loads the modules of a folder that are new or have changed: each has a function install(region). The names of those loaded.

        Calling it again while the region runs brings in what has changed since.
        """
        loaded = []
        for name in sorted(os.listdir(folder)):
            at = os.path.join(folder, name)
            if name.endswith(".py") and self.deployed.get(at) != (changed := os.path.getmtime(at)):
                spec = importlib.util.spec_from_file_location(f"region_{name[:-3]}", at)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                module.install(self)
                self.deployed[at] = changed
                loaded.append(name[:-3])
        return loaded

    def register(self, transaction: str, program: Program, name: str | None = None) -> None:
        self.transactions[transaction] = program
        self.programs[name or transaction] = program

    def define(self, name: str, program: Program) -> None:
        """A program for LINK and XCTL that no transaction starts."""
        self.programs[name] = program

    def link(self, name: str, df: DataFrame) -> DataFrame:
        """LINK, or XCTL as the last step: the requests as the program leaves them; PGMIDERR if there is none of that name."""
        if name not in self.programs:
            return df.withColumn("condition", F.lit("PGMIDERR"))
        return self.programs[name](df)

    def read_file(self, df: DataFrame, resource: str, key: str) -> DataFrame:
        """READ of a file resource for each request: its columns, and condition FILENOTFOUND or, without a record, NOTFND."""
        if resource not in self.resources:
            return df.withColumn("condition", F.lit("FILENOTFOUND"))
        hit = self.resources[resource].withColumn("_hit", F.lit(True))
        out = df.join(hit, key, "left")
        return out.withColumn("condition", F.when(F.col("_hit"), "NORMAL").otherwise("NOTFND")).drop("_hit")

    def read_table(self, df: DataFrame, resource: str, key: str) -> DataFrame:
        """The same of a table of a database, a function that gives its frame; condition DBNOTFOUND if there is none of that name."""
        if resource not in self.tables:
            return df.withColumn("condition", F.lit("DBNOTFOUND"))
        self.resources[resource] = self.tables[resource]()
        return self.read_file(df, resource, key)

    def dispatch(self, requests: DataFrame) -> DataFrame:
        """Requests with commarea as their programs leave it, and condition: what a program set, NORMAL, or TRANSIDERR for unknown names.

        One pass for all rules and unknown names, and one for each program, which sees its own requests.
        """
        programs = F.coalesce(F.col("trans_id").isin(list(self.transactions)), F.lit(False))
        ruled = F.col("trans_id").isin(list(self.rules))
        changed = reduce(lambda out, r: F.when(F.col("trans_id") == r[0], r[1](F.col("commarea"))).otherwise(out), self.rules.items(), F.col("commarea"))
        out = requests.where(~programs) if self.transactions else requests
        out = out.withColumn("commarea", changed).withColumn("condition", F.when(ruled, "NORMAL").otherwise("TRANSIDERR"))
        for name, program in self.transactions.items():
            done = program(requests.where(F.col("trans_id") == name))
            out = out.unionByName(done if "condition" in done.columns else done.withColumn("condition", F.lit("NORMAL")), allowMissingColumns=True)
        return out


def response(condition: Column) -> Column:
    """The response code of a condition; null for one that isn't known."""
    out = F.lit(None).cast("int")
    for name, code in RESPONSES.items():
        out = F.when(condition == name, code).otherwise(out)
    return out


class Queues:
    """Temporary storage queues in a folder: rows queue, item (from 1) and data. Writes come as batches; a queue's items are numbered by seq.

    A write adds files, a delete adds a row that hides what its queue held: both are there wholly or not at all, and another driver goes on
    where the last one ended. An item's number is its place among all that its queue has held since it was deleted last.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/queues-{uuid.uuid4().hex}"

    def _next(self) -> int:
        return max((int(n.split("=")[1]) for n in folders.children(self.spark, self.folder) if n.startswith("batch=")), default=0) + 1

    def _all(self) -> DataFrame:
        if not folders.children(self.spark, self.folder):
            return self.spark.createDataFrame([], _HELD)
        return self.spark.read.schema(_HELD).option("basePath", self.folder).parquet(f"{self.folder}/batch=*")

    @property
    def items(self) -> DataFrame:
        rows = self._all()
        gone = rows.where("item is null").groupBy("queue").agg(F.max("batch").alias("_gone"))
        return rows.where("item is not null").join(gone, "queue", "left").where("_gone is null or batch > _gone").select("queue", "item", "data")

    def _add(self, rows: DataFrame) -> None:
        number = self._next()
        held = f"{self.folder}/.{uuid.uuid4().hex}"
        rows.select("queue", F.col("item").cast("long").alias("item"), "data").write.parquet(held)
        folders.rename(self.spark, held, f"{self.folder}/batch={number}")

    def write(self, new: DataFrame) -> None:
        """Adds rows queue, seq, data behind what their queues hold."""
        depth = self.items.groupBy("queue").agg(F.max("item").alias("_n"))
        place = F.row_number().over(Window.partitionBy("queue").orderBy("seq"))
        numbered = new.withColumn("_p", place).join(depth, "queue", "left")
        self._add(numbered.select("queue", (F.col("_p") + F.coalesce("_n", F.lit(0))).alias("item"), "data"))

    def read(self, queue: str, item: int) -> DataFrame:
        return self.items.where((F.col("queue") == queue) & (F.col("item") == item))

    def browse(self, queue: str, after: int = 0) -> DataFrame:
        """READ NEXT to the end, behind an item."""
        return self.items.where((F.col("queue") == queue) & (F.col("item") > after)).orderBy("item")

    def delete(self, *queues: str) -> None:
        self._add(self.spark.createDataFrame([(q, None, None) for q in queues], "queue string, item long, data string"))

    def depth(self) -> DataFrame:
        return self.items.groupBy("queue").agg(F.count("*").alias("depth"))
