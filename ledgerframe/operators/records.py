"""SORT, MERGE, SEARCH, keyed READ, START, REWRITE, DELETE, matched merge, control breaks, running values, calls by key and MOVE CORRESPONDING."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..picture import Layout


def sort(df: DataFrame, *keys: str | tuple[str, str], input_procedure: Callable[[DataFrame], DataFrame] | None = None, output_procedure: Callable[[DataFrame], DataFrame] | None = None, in_order: bool | str = False) -> DataFrame:
    """SORT by keys, a pair (name, 'desc') descending; procedures transform what is released and returned.

    in_order: WITH DUPLICATES IN ORDER, equal keys stay in the order of the column named, or of the frame's partitions and rows.
    """
    df = input_procedure(df) if input_procedure else df
    order = [F.col(k) if isinstance(k, str) else F.col(k[0]).desc() if k[1] == "desc" else F.col(k[0]) for k in keys]
    if in_order is True:  # the number must be given before rows move
        df = df.withColumn("_order", F.monotonically_increasing_id()).orderBy(*order, "_order").drop("_order")
    else:
        df = df.orderBy(*order, *([in_order] if in_order else []))
    return output_procedure(df) if output_procedure else df


def top(df: DataFrame, n: int, *keys: str | tuple[str, str]) -> DataFrame:
    """The first n records of an order: each task keeps n at most."""
    return sort(df, *keys).limit(n)


def sort_table(table: Column, *keys: str | tuple[str, str] | None) -> Column:
    """SORT of a table in the record, by fields of its elements; without keys by the elements themselves. Equal elements stay in order."""
    numbered_ = F.transform(table, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def compared(a: Column, b: Column) -> Column:
        out = F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)
        for k in reversed(keys or (None,)):
            name, down = (k[0], k[1] == "desc") if isinstance(k, tuple) else (k, False)
            x, y = (a["x"], b["x"]) if name is None else (a["x"][name], b["x"][name])
            out = F.when(x < y, 1 if down else -1).when(x > y, -1 if down else 1).otherwise(out)
        return out

    return F.transform(F.array_sort(numbered_, compared), lambda e: e["x"])


def merge(*files: DataFrame, keys: list) -> DataFrame:
    """MERGE of files with the same record; equal keys in the order of the files."""
    both = files[0].withColumn("_file", F.lit(0))
    for i, f in enumerate(files[1:], 1):
        both = both.unionByName(f.withColumn("_file", F.lit(i)))
    return sort(both, *keys, "_file").drop("_file")


def search(table: Column, predicate: Callable[[Column], Column], start: int = 1) -> Column:
    """SEARCH in a table of the record: the first index from start whose element fits; null AT END."""
    numbered = F.transform(table, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    return F.get(F.filter(numbered, lambda e: (e["i"] >= start) & predicate(e["x"])), F.lit(0))["i"]


def lookup(df: DataFrame, table: DataFrame, on: list[str] | Column, how: str = "left") -> DataFrame:
    """SEARCH ALL, or a keyed READ for each record: a join; Spark broadcasts the table if its size allows."""
    return df.join(table, on, how)


def search_range(df: DataFrame, table: DataFrame, value: str, low: str, high: str, width: int, first: str | None = None) -> DataFrame:
    """SEARCH in a large table of ranges: the table's columns where value lies between low and high, null where there is none.

    Ranges and values meet by the cell of the given width that they are in, an equality join, so that no row is compared with the whole
    table; of several ranges that hold a value the one with the smallest first (low if None) counts.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    own = [c for c in table.columns if c not in df.columns]
    ranges = table.select(F.explode(F.sequence(cell(low), cell(high))).alias("_cell"), F.col(low).alias("_low"), F.col(high).alias("_high"), F.struct(F.col(first or low).alias("_first"), *own).alias("_hit"))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_cell", cell(value))
    met = rows.join(ranges, (rows["_cell"] == ranges["_cell"]) & F.col(value).between(F.col("_low"), F.col("_high")), "left")
    best = met.groupBy("_row", *df.columns).agg(F.min("_hit").alias("_hit"))
    return best.select(*df.columns, *(F.col(f"_hit.{c}") for c in own))


def call_by_key(df: DataFrame, key: str, program: Callable[[DataFrame], DataFrame], how: str = "left") -> DataFrame:
    """CALL of a program for each key, as one plan: it gets the distinct keys and returns rows by key, which are joined back."""
    return df.join(program(df.select(key).where(F.col(key).isNotNull()).distinct()), key, how)


def read_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


#: Relations of START.
START = {"EQUAL": Column.__eq__, "GREATER": Column.__gt__, "NOT LESS": Column.__ge__, "GREATER OR EQUAL": Column.__ge__}


def start(df: DataFrame, key: str, relation: str, value: object) -> DataFrame:
    """START, then READ NEXT to the end: the records in key order from a position."""
    return df.where(START[relation](F.col(key), F.lit(value))).orderBy(key)


def write_keyed(store: DataFrame, new: DataFrame, key: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """WRITE to an indexed file: the file after it, and the rejects (status 22) whose key was there, or came before among the new ones.

    order: the column by which new records come; without one the smallest record of a key counts as its first.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order or F.struct(*new.columns)))
    there = store.select(F.col(key).alias("_there"))
    told = new.withColumn("_n", place).join(there, F.col(key) == F.col("_there"), "left").withColumn("_fresh", F.col("_there").isNull() & (F.col("_n") == 1))
    return store.unionByName(told.where("_fresh").select(new.columns)), told.where("not _fresh").select(new.columns)


def rewrite(store: DataFrame, changed: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """REWRITE by key: changed records replace theirs; those of no key there are left out (status 23). Of changes to one key the last counts.

    order: the column by which changes come (it isn't stored); without one the largest record of a key counts as its last.
    """
    fields = [x for x in changed.columns if x not in (key, order)]
    last = F.max(F.struct(*([order] if order else []), F.struct(*fields).alias("_new")))
    c = changed.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_last")).select(key, F.col("_last._new").alias("_new"))
    both = store.join(c, key, "left")
    pick = lambda n: F.when(F.col("_new").isNotNull(), F.col(f"_new.{n}")).otherwise(F.col(n)).alias(n) if n in fields else F.col(n)
    return both.select(*(pick(n) for n in store.columns))


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key), key, "left_anti").select(store.columns)


def matched_merge(master: DataFrame, transactions: DataFrame, key: str) -> DataFrame:
    """Match-merge of two files: a full join with `matched`: both, master or transaction."""
    m, t = master.withColumn("_m", F.lit(True)), transactions.withColumn("_t", F.lit(True))
    out = m.join(t, key, "full")
    return out.withColumn("matched", F.expr("case when _m and _t then 'both' when _m then 'master' else 'transaction' end")).drop("_m", "_t")


def control_break(df: DataFrame, levels: list[str], **totals: Column) -> DataFrame:
    """Totals at each change of a level, and the grand total; break_level: how many levels a total is over."""
    out = df.rollup(*levels).agg(F.grouping_id().alias("_g"), *(c.alias(n) for n, c in totals.items()))
    return out.withColumn("break_level", F.lit(len(levels)) - F.bit_count("_g")).drop("_g")


def running(df: DataFrame, by: list[str], order: list[str], function: Callable[[Column], Column] = F.sum, **values: Column) -> DataFrame:
    """Running sums (or another aggregate) in the order of records within a key."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({n: function(c).over(w) for n, c in values.items()})


def previous(df: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """What a loop keeps of the record before: values of the key's previous record, null at the first (a control break)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({n: F.lag(c).over(w) for n, c in values.items()})


def corresponding(df: DataFrame, source: Layout | list[str], target: Layout | list[str]) -> DataFrame:
    """MOVE CORRESPONDING: the fields of both, by name, in the target's order."""
    names = lambda x: [f.name for f in x.fields] if isinstance(x, Layout) else x
    own = set(names(source))
    return df.select(*(n for n in names(target) if n in own))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order in which they come first."""
    return df.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)


def split(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Records that pass a check, and the rejects (null counts as failing)."""
    told = checked(df, valid)
    return told.where("not rejected").drop("rejected"), told.where("rejected").drop("rejected")


def checked(df: DataFrame, valid: Column, name: str = "rejected") -> DataFrame:
    """All records, and whether each fails a check, in one pass over them."""
    return df.withColumn(name, ~F.coalesce(valid, F.lit(False)))
