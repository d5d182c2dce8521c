"""Figurative constants, INITIALIZE, SET, table elements, CORRESPONDING arithmetic and ACCEPT FROM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..picture import Field, Layout
from . import numeric, strings

#: The character of a figurative constant.
FIGURATIVE = {"SPACE": " ", "SPACES": " ", "ZERO": "0", "ZEROS": "0", "ZEROES": "0", "HIGH-VALUE": "\xff", "HIGH-VALUES": "\xff", "LOW-VALUE": "\0", "LOW-VALUES": "\0", "QUOTE": '"', "QUOTES": '"'}


def filled(constant: str, field: Field) -> Column:
    """MOVE of a figurative constant: the field's size of its character; zero (or nothing that is a number) in a number."""
    if field.pic is None or not field.pic.numeric:
        return F.lit(FIGURATIVE[constant.upper()] * field.item_size)
    return F.lit(0).cast(field.pic.spark_type())


def initial(field: Field) -> Column:
    """INITIALIZE: numbers 0, text blanks, groups and tables in depth."""
    if field.pic is None:
        one = F.struct(*(initial(c).alias(c.name) for c in field.children if c.name != "FILLER"))
    else:
        one = filled("ZEROS" if field.pic.numeric else "SPACES", field)
    return F.array_repeat(one, field.occurs) if field.occurs > 1 else one


def initialized(df: DataFrame, layout: Layout, *names: str) -> DataFrame:
    chosen = {n.upper().replace("-", "_") for n in names}
    return df.withColumns({f.name: initial(f) for f in layout.fields if f.name != "FILLER" and (not chosen or f.name in chosen)})


def set_true(field: Field, name: str) -> Column:
    """SET condition TO TRUE: the field's value is the condition's first (of a range, its low end)."""
    v = dict(field.conditions)[name.upper().replace("-", "_")][0]
    v = F.lit(v[0] if isinstance(v, tuple) else v)
    return numeric.moved(numeric.numeric_text(v), field.pic) if field.pic.numeric else strings.padded(v, field.pic.size)


def element(table: Column, index: int | Column) -> Column:
    """F(i), from 1; null beyond the table."""
    return F.try_element_at(table, F.lit(index) if isinstance(index, int) else index)


def set_element(table: Column, index: int | Column, value: Column) -> Column:
    """The table after MOVE value TO F(i); unchanged if i is beyond it."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.transform(table, lambda x, k: F.when(k + 1 == i, value).otherwise(x))


def character_wise(x: Column, change: Callable[[Column], Column]) -> Column:
    """INSPECT with a function of one character."""
    return F.array_join(F.transform(F.split(x, ""), change), "")


def corresponding(df: DataFrame, source: Layout, target: Layout, verb: str, prefix: str) -> DataFrame:
    """ADD or SUBTRACT CORRESPONDING: the target's columns stand under its names, the source's after the prefix; size errors keep."""
    sign, own = (1 if verb.upper() == "ADD" else -1), {f.name for f in source.fields if f.pic and f.pic.numeric}
    both = [f for f in target.fields if f.pic and f.pic.numeric and f.occurs == 1 and f.name in own and {f.name, prefix + f.name} <= set(df.columns)]
    return df.withColumns({f.name: numeric.stored(F.col(f.name) + sign * F.col(prefix + f.name), f.pic, F.col(f.name)) for f in both})


def accept(what: str) -> Column:
    """ACCEPT FROM: DATE (YYMMDD), DATE YYYYMMDD, DAY (YYDDD), DAY YYYYDDD, DAY-OF-WEEK (1 is Monday), TIME (HHMMSSss)."""
    now = F.current_timestamp()
    if what.upper() == "DAY-OF-WEEK":
        return (F.weekday(now) + 1).cast("string")
    #: What each gives, as patterns of dates.
    form = {"DATE": "yyMMdd", "DATE YYYYMMDD": "yyyyMMdd", "DAY": "yyDDD", "DAY YYYYDDD": "yyyyDDD", "TIME": "HHmmssSS"}[what.upper()]
    return F.date_format(now, form)
