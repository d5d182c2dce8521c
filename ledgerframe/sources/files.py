"""Files: fixed (FB) and varying (VB) records, relative numbers, sorts from file to file, print lines, lines, JSON and XML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import sort
from ..picture import Layout
from .codec import records, to_records
from .fixedrec import listed, register, resolved


#: File status codes.
STATUS = {
    "00": "success", "10": "end of file", "22": "duplicate key", "23": "no such record", "24": "boundary", "30": "permanent error",
    "35": "file not found", "37": "open mode", "41": "file already open, or no record read",
}


def status(path: str, spark: SparkSession | None = None) -> str:
    """What OPEN INPUT of a path reports: 00, 35 if there is none, 30 on other errors."""
    try:
        listed(resolved(spark, path) if spark else path)
    except FileNotFoundError:
        return "35"
    except OSError:
        return "30"
    return "00"


def _scan(spark: SparkSession, path: str, layout: Layout, encoding: str | None, **options: object) -> DataFrame:
    blank = 64 if encoding else 32
    return register(spark).read.format("fixedrec").options(recordLength=layout.size, blank=blank, **options).load(resolved(spark, path))


def _sink(df: DataFrame, path: str, layout: Layout, encoding: str | None, mode: str, **options: object) -> None:
    register(df.sparkSession)
    data = to_records(df, layout, encoding=encoding).select(F.lit(None).cast("long").alias("rrn"), "value")
    data.write.format("fixedrec").options(recordLength=layout.size, blank=64 if encoding else 32, **options).mode(mode).save(resolved(df.sparkSession, path))


def read_fixed(spark: SparkSession, path: str, layout: Layout, encoding: str | None = None, partial: str = "pad") -> DataFrame:
    """Records of equal length, files split anywhere between records; a file's short last record is padded with blanks, or dropped."""
    return records(_scan(spark, path, layout, encoding, partial=partial), layout, encoding=encoding)


def read_variable(spark: SparkSession, path: str, layout: Layout, encoding: str | None = None) -> DataFrame:
    """Records after 4-byte descriptor words, whose length counts the word; a file is walked by one task, as it can't be split."""
    return records(_scan(spark, path, layout, encoding, format="VB"), layout, encoding=encoding)


def write_fixed(df: DataFrame, path: str, layout: Layout, encoding: str | None = None, mode: str = "overwrite") -> None:
    """OPEN OUTPUT (overwrite) or EXTEND (append), then WRITE of each row; a sorted frame's order is that of the files' names."""
    _sink(df, path, layout, encoding, mode)


def write_variable(df: DataFrame, path: str, layout: Layout, encoding: str | None = None, mode: str = "overwrite") -> None:
    _sink(df, path, layout, encoding, mode, format="VB")


def read_relative(spark: SparkSession, path: str, layout: Layout, encoding: str | None = None) -> DataFrame:
    """Relative organization: the records of a fixed file with rrn, their number, which follows from the place in the file."""
    data = _scan(spark, path, layout, encoding)
    return records(data, layout, encoding=encoding, keep=("rrn",))


@dataclass
class RecordFile:
    """A file of fixed records with its hooks: functions that are called, with the file, when it is opened and closed, and its status."""

    spark: SparkSession
    path: str
    layout: Layout
    encoding: str | None = None
    on_open: Callable[[RecordFile], None] | None = None
    on_close: Callable[[RecordFile], None] | None = None
    status: str = ""
    mode: str = ""

    def open(self, mode: str = "INPUT") -> str:
        self.status = "41" if self.mode else status(self.path, self.spark) if mode in ("INPUT", "I-O") else "00"
        if self.status == "00":
            self.mode = mode
            if self.on_open:
                self.on_open(self)
        return self.status

    def read(self) -> DataFrame:
        """All records, by rrn."""
        if self.mode not in ("INPUT", "I-O"):
            self.status = "37"
            raise OSError(f"{self.path} isn't open for reading: status 37")
        return read_relative(self.spark, self.path, self.layout, self.encoding)

    def write(self, df: DataFrame) -> str:
        """WRITE of each row; in mode I-O the rows, as read() gave them, replace those of the file (REWRITE)."""
        self.status = "00" if self.mode in ("OUTPUT", "EXTEND", "I-O") else "37"
        if self.status == "00":
            rows = df.orderBy("rrn").drop("rrn") if "rrn" in df.columns else df
            write_fixed(rows, self.path, self.layout, self.encoding, "append" if self.mode == "EXTEND" else "overwrite")
        return self.status

    def close(self) -> str:
        self.status, self.mode = ("00", "") if self.mode else ("41", "")
        if self.status == "00" and self.on_close:
            self.on_close(self)
        return self.status


def rewrite_file(spark: SparkSession, path: str, giving: str, layout: Layout, change: Callable[[DataFrame], DataFrame], encoding: str | None = None) -> None:
    """OPEN I-O, READ and REWRITE of each record: files don't change in place, so that the result is written beside."""
    write_fixed(change(read_fixed(spark, path, layout, encoding)), giving, layout, encoding)


def sort_file(spark: SparkSession, using: list[str], giving: str, layout: Layout, *keys: str | tuple[str, str], encoding: str | None = None) -> None:
    """SORT or MERGE USING files GIVING a file; equal keys in the order of files and records."""
    parts = [read_relative(spark, p, layout, encoding).withColumn("_file", F.lit(i)) for i, p in enumerate(using)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    write_fixed(sort(both, *keys, "_file", "rrn"), giving, layout, encoding)


def advanced(df: DataFrame, line: str, lines: int, after: bool = True, page: Column | None = None) -> DataFrame:
    """WRITE AFTER (BEFORE) ADVANCING: each line with lines - 1 empty ones before (after) it; where page is true, a form feed."""
    blank = F.array_repeat(F.lit(""), max(lines - 1, 0))
    text = F.col(line) if page is None else F.when(page, F.concat(F.lit("\f"), F.col(line))).otherwise(F.col(line))
    return df.select(F.explode(F.concat(blank, F.array(text)) if after else F.concat(F.array(text), blank)).alias(line))


def write_lines(df: DataFrame, path: str, layout: Layout, encoding: str | None = None) -> None:
    """LINE SEQUENTIAL: each record's bytes and a line end; text records only (a binary number may hold a line end)."""
    data = to_records(df, layout, encoding=encoding)
    data.select(F.decode("value", "ISO-8859-1").alias("value")).write.mode("overwrite").option("encoding", "ISO-8859-1").text(path)


def read_lines(spark: SparkSession, path: str, layout: Layout, encoding: str | None = None) -> DataFrame:
    lines = spark.read.option("encoding", "ISO-8859-1").text(path)
    return records(lines.select(F.encode(F.rpad("value", layout.size, " "), "ISO-8859-1").alias("value")), layout, encoding=encoding)


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def from_json(df: DataFrame, layout: Layout, column: str = "json") -> DataFrame:
    return df.select(F.from_json(column, layout.struct()).alias("r")).select("r.*")


def to_xml(df: DataFrame, root: str, name: str = "xml") -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": root}).alias(name))


def from_xml(df: DataFrame, layout: Layout, root: str, column: str = "xml") -> DataFrame:
    return df.select(F.from_xml(column, layout.struct(), {"rowTag": root}).alias("r")).select("r.*")
