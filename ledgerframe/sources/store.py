"""Record stores: a keyed table of one layout in a folder, changed by whole snapshots, and brought up to a new layout by migrate().

A change writes a snapshot beside the current one; the newest complete one counts, so that a job that ends early changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import records
from ..picture import Layout


def fingerprint(layout: Layout) -> str:
    """SHA-256 of names, pictures, usages, signs and tables; values and conditions don't count."""
    parts = [f"{f.name}|{f.pic.text if f.pic else ''}|{f.usage}|{f.sign}|{f.occurs}|{f.offset}" for f in layout.walk()]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def blank(kind: T.DataType) -> Column:
    """What a field of a type holds before anything is moved to it: 0, or an empty text."""
    return F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("") if isinstance(kind, T.StringType) else F.lit(None).cast(kind)


#: Types of whole numbers, decimals and texts by database; {p}, {s} and {n} are digits, decimals and size.
DIALECTS = {
    "h2": ("SMALLINT", "INTEGER", "BIGINT", "DECIMAL({p},{s})", "VARCHAR({n})"),
    "sqlite": ("INTEGER", "INTEGER", "INTEGER", "NUMERIC", "TEXT"),
    "postgresql": ("SMALLINT", "INTEGER", "BIGINT", "NUMERIC({p},{s})", "VARCHAR({n})"),
    "mysql": ("SMALLINT", "INT", "BIGINT", "DECIMAL({p},{s})", "VARCHAR({n})"),
    "oracle": ("NUMBER(5)", "NUMBER(10)", "NUMBER(19)", "NUMBER({p},{s})", "VARCHAR2({n})"),
    "derby": ("SMALLINT", "INTEGER", "BIGINT", "DECIMAL({p},{s})", "VARCHAR({n})"),
}


def dialect(url: str) -> str:
    """The dialect of a JDBC URL."""
    name = url.removeprefix("jdbc:").split(":")[0]
    return name if name in DIALECTS else "h2"


def ddl(layout: Layout, key: str, database: str = "h2") -> str:
    """CREATE TABLE of a layout's elementary fields."""
    small, middle, big, decimal, text = DIALECTS[database]
    columns = []
    for f in layout.walk():
        if f.pic is None or f.name == "FILLER" or f.redefines:
            continue
        whole = f.pic.numeric and not f.pic.decimals
        kind = (small if f.pic.digits <= 4 else middle if f.pic.digits <= 9 else big if f.pic.digits <= 18 else decimal) if whole else decimal if f.pic.numeric else text
        columns.append(f"{f.name} {kind.format(p=max(f.pic.digits, 1), s=f.pic.decimals, n=f.item_size)}" + (" NOT NULL" if f.name == key else ""))
    return f"CREATE TABLE {layout.name} ({', '.join(columns)}, PRIMARY KEY ({key}))"


@dataclass
class RecordStore:
    spark: SparkSession
    path: str
    layout: Layout
    key: str
    indexes: tuple[str, ...] = ()  # taken, and of no effect: files of columns with statistics have none

    def _folders(self) -> list[tuple[int, str]]:
        """Complete snapshots, by number: one driver-side listing of folder names."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("snapshot-")]
        done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted((int(p.getName().split("-")[1]), p.toString()) for p in done)

    def _write(self, df: DataFrame) -> None:
        number = max((n for n, _ in self._folders()), default=0) + 1
        df.withColumn("_layout", F.lit(fingerprint(self.layout))).write.mode("overwrite").parquet(f"{self.path}/snapshot-{number}")

    def _raw(self) -> DataFrame | None:
        folders = self._folders()
        return self.spark.read.parquet(folders[-1][1]) if folders else None

    def find_all(self) -> DataFrame:
        """All records in the store's layout; fields that the snapshot lacks are 0 or empty, those that it has beyond are left out."""
        raw = self._raw()
        if raw is None:
            return self.spark.createDataFrame([], self.layout.struct())
        cols = [(F.coalesce(F.col(f.name).cast(f.dataType), blank(f.dataType)) if f.name in raw.columns else blank(f.dataType)).alias(f.name) for f in self.layout.struct()]
        return raw.select(*cols)

    def find_by_key(self, value: object) -> DataFrame:
        return records.read_key(self.find_all(), self.key, value)

    def find_where(self, condition: str, **host: object) -> DataFrame:
        """Records of a SQL condition; :NAME stands for a value."""
        return self.spark.sql(f"select * from {{rows}} where {condition}", args=host, rows=self.find_all())

    def count(self) -> int:
        return self.find_all().count()

    def insert(self, new: DataFrame) -> DataFrame:
        """Adds records; returns the rejects, whose key was there (status 22). Of new ones with one key, all but one are rejected, too."""
        ranked = new.withColumn("_n", F.row_number().over(records.Window.partitionBy(self.key).orderBy(*new.columns)))
        after, taken = records.write_keyed(self.find_all(), ranked.where("_n = 1").drop("_n"), self.key)
        rejects = taken.unionByName(ranked.where("_n > 1").drop("_n"))
        self._write(after)
        return rejects

    def update(self, changed: DataFrame) -> None:
        self._write(records.rewrite(self.find_all(), changed, self.key))

    def upsert(self, changed: DataFrame) -> None:
        old = self.find_all()
        fresh = changed.join(old.select(self.key), self.key, "left_anti").select(changed.columns)
        self._write(records.rewrite(old, changed, self.key).unionByName(fresh))

    def delete(self, keys: DataFrame) -> None:
        self._write(records.delete(self.find_all(), keys, self.key))

    def drop_all(self) -> None:
        self._write(self.find_all().limit(0))

    def version(self) -> str | None:
        """The fingerprint of the layout that wrote the current snapshot; null for an empty one."""
        raw = self._raw()
        row = raw.select("_layout").first() if raw is not None else None
        return row[0] if row else None

    def migrate(self, fill: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Rewrites the store in its layout if another one wrote it; fill may set new fields. Whether there was anything to do."""
        if self.version() in (None, fingerprint(self.layout)):
            return False
        df = self.find_all()
        self._write(fill(df) if fill else df)
        return True
