"""Embedded SQL: statements with :HOST variables, SQLCODE and SQLSTATE, cursors and units of work over views and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from .sources import folders


@dataclass
class Result:
    """SQLCODE, SQLSTATE, rows that were changed (SQLERRD 3), the row that was found, and the text of an error (SQLERRMC)."""

    code: int = 0
    state: str = "00000"
    rows: int = 0
    value: Row | None = None
    text: str = ""

    @property
    def warning(self) -> str:
        """SQLWARN0: W where no row was found or changed."""
        return "W" if self.code == 100 else " "


def _named(text: str) -> str:
    """:VAR-NAME to a named parameter; text in quotes stays."""
    return re.sub(r"('[^']*')|:([A-Za-z][\w-]*)", lambda m: m[1] or ":" + m[2].replace("-", "_"), text)


def _arguments(text: str, host: dict) -> dict:
    asked = {m[2].replace("-", "_") for m in re.finditer(r"('[^']*')|:([A-Za-z][\w-]*)", text) if m[2]}
    values = {k.replace("-", "_").upper(): v for k, v in host.items()}
    return {n: v.rstrip() if isinstance(v := values[n.upper()], str) else v for n in asked}


def _failed(e: PySparkException) -> Result:
    return Result(-1, e.getSqlState() or "42000", text=str(e).splitlines()[0][:70])


@dataclass
class Session:
    """Statements over views. With a folder, commit() writes the changed tables there, all or none, and a later session finds them again."""

    spark: SparkSession
    strict: bool = False
    folder: str | None = None
    staged: dict[str, DataFrame] = field(default_factory=dict)
    cursors: dict[str, str] = field(default_factory=dict)
    opened: dict[str, Iterator[Row]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for number, names in self._commits():
            for name in names:
                self.spark.read.parquet(f"{self.folder}/commit-{number:09}/{name}").createOrReplaceTempView(name)

    def _commits(self) -> list[tuple[int, list[str]]]:
        """Complete commits in order, and the tables in each: those whose mark was set last of all."""
        out = []
        for name in folders.children(self.spark, self.folder) if self.folder else []:
            inside = folders.children(self.spark, f"{self.folder}/{name}") if name.startswith("commit-") else []
            if "_COMMITTED" in inside:
                out.append((int(name.removeprefix("commit-")), [x for x in inside if x != "_COMMITTED"]))
        return out

    def query(self, text: str, **host: object) -> DataFrame:
        return self.spark.sql(_named(text), args=_arguments(text, host))

    def select_into(self, text: str, **host: object) -> Result:
        """SELECT ... INTO :a, :b ...: 0 with the row, 100 if there is none, -811 for several rows (strict only), below 0 on errors."""
        text = re.sub(r"\bINTO\s+:[\w-]+(\s*,\s*:[\w-]+)*", "", text, flags=re.IGNORECASE)
        try:
            rows = self.query(text, **host).limit(2).collect()
        except PySparkException as e:
            return _failed(e)
        if not rows:
            return Result(100, "02000")
        return Result(-811, "21000", 2) if len(rows) > 1 and self.strict else Result(0, "00000", 1, rows[0])

    def declare(self, cursor: str, text: str) -> None:
        self.cursors[cursor] = text

    def open(self, cursor: str, **host: object) -> Result:
        try:
            self.opened[cursor] = self.rows(cursor, **host).toLocalIterator(prefetchPartitions=True)
        except PySparkException as e:
            return _failed(e)
        return Result()

    def rows(self, cursor: str, **host: object) -> DataFrame:
        """All rows of a declared cursor as one frame, for what doesn't need them one by one."""
        return self.query(self.cursors[cursor], **host)

    def fetch(self, cursor: str) -> Result:
        if cursor not in self.opened:
            return Result(-501, "24501", text=f"{cursor} isn't open")
        row = next(self.opened[cursor], None)
        return Result(100, "02000") if row is None else Result(0, "00000", 1, row)

    def close(self, cursor: str) -> Result:
        return Result() if self.opened.pop(cursor, None) is not None else Result(-501, "24501", text=f"{cursor} isn't open")

    # Changes are staged as new DataFrames under the view's name; commit() makes them the view, rollback() drops them.
    def _table(self, name: str) -> DataFrame:
        return self.staged[name] if name in self.staged else self.spark.table(name)

    def insert(self, table: str, rows: DataFrame) -> Result:
        old = self._table(table)
        self.staged[table] = old.unionByName(rows.select(*(rows[c].cast(old.schema[c].dataType) for c in old.columns)))
        return Result(rows=rows.count())

    def update(self, table: str, where: str, **sets: str) -> Result:
        old = self._table(table)
        n = old.where(where).count()
        new = {c: f"case when {where} then cast({e} as {old.schema[c].dataType.simpleString()}) else {c} end" for c, e in sets.items()}
        self.staged[table] = old.selectExpr(*(f"{new[c]} as {c}" if c in new else c for c in old.columns))
        return Result(100 if self.strict and not n else 0, "02000" if self.strict and not n else "00000", n)

    def delete(self, table: str, where: str) -> Result:
        old = self._table(table)
        n = old.where(where).count()
        self.staged[table] = old.where(f"not coalesce({where}, false)")
        return Result(100 if self.strict and not n else 0, "02000" if self.strict and not n else "00000", n)

    def commit(self) -> Result:
        """Makes the changes visible; with a folder they are written first, and count once the mark behind the last table is set."""
        if self.folder and self.staged:
            # Behind what any earlier session began, complete or not.
            begun = [int(x.removeprefix("commit-")) for x in folders.children(self.spark, self.folder) if x.startswith("commit-")]
            at = f"{self.folder}/commit-{max(begun, default=0) + 1:09}"
            for name, df in self.staged.items():
                df.write.parquet(f"{at}/{name}")
            folders.touch(self.spark, f"{at}/_COMMITTED")
            self.staged = {name: self.spark.read.parquet(f"{at}/{name}") for name in self.staged}
        for name, df in self.staged.items():
            df.createOrReplaceTempView(name)
        self.staged.clear()
        return Result()

    def rollback(self) -> Result:
        self.staged.clear()
        return Result()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()
