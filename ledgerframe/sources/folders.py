"""Folders that the whole cluster sees, on whatever file system their paths name: driver-side steps that move no data."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def make(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.mkdirs(at)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, which is there wholly or not at all."""
    fs, at = _at(spark, path)
    fs.create(at, True).close()


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Whether it was renamed; not onto what is there."""
    fs, at = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    return not fs.exists(target) and fs.rename(at, target)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def shared(spark: SparkSession) -> str:
    """The folder for results of steps: spark.checkpoint.dir; one of this machine only where that is unset and all runs here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return at or tempfile.mkdtemp(prefix="ledgerframe-")
