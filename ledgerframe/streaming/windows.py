"""Windows over streams by event time, with watermarks: tumbling, sliding and session windows, and their results by the newest batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, time: str, length: str, late: str, *by: str, slide: str | None = None, **totals: Column) -> DataFrame:
    """Totals by window of a length (and slide) and key; rows later than the watermark allows are left out."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w.alias("_w"), *by).agg(*(c.alias(n) for n, c in totals.items())).select("_w.start", "_w.end", *by, *totals)


def sessions(stream: DataFrame, time: str, gap: str, late: str, *by: str, **totals: Column) -> DataFrame:
    """Totals by session: a key's rows without a gap of that length between them."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w.alias("_w"), *by).agg(*(c.alias(n) for n, c in totals.items())).select("_w.start", "_w.end", *by, *totals)


def kept(totals: DataFrame, target: str, checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Writes what each batch changes; a batch's result replaces what an earlier try of it left."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return totals.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest(spark: SparkSession, target: str, *by: str) -> DataFrame:
    """Of what kept() wrote in update mode, each key's newest row."""
    rows = spark.read.parquet(target)
    values = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max(F.struct("batch", *values)).alias("_r")).select(*by, *(f"_r.{c}" for c in values))
