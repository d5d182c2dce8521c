"""Intrinsic functions by name: call("UPPER-CASE", column). WHEN-COMPILED is the time at which the plan is built."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import floor_mod, median, truncated


def numval(x: Column, currency: bool = False, wide: str = "decimal(38,10)") -> Column:
    """The number in a text, a sign before or after it; with currency also its sign and commas. 0 where there is none."""
    s = F.regexp_replace(F.upper(x), "[$, ]" if currency else " ", "")
    negative = F.regexp_like(s, F.lit("^-|-$|(CR|DB)$"))
    number = F.regexp_replace(s, "^[+-]|([+-]|CR|DB)$", "").try_cast(wide)
    return F.coalesce(F.when(negative, -number).otherwise(number), F.lit(0).cast(wide))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "ABS": F.abs,
    "CHAR": lambda n: F.char(n - 1),
    "CONCATENATE": F.concat,
    "CURRENT-DATE": lambda: F.concat(F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSS"), F.date_format(F.current_timestamp(), "xx")),
    "INTEGER": F.floor,
    "INTEGER-PART": lambda x: truncated(x, 0),
    "LENGTH": F.length,
    "LOG": lambda x: F.ln(x).cast("decimal(38,16)"),
    "LOG10": lambda x: F.log10(x).cast("decimal(38,16)"),
    "LOWER-CASE": F.lower,
    "MAX": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "MEAN": lambda *x: F.round(reduce(lambda a, b: a + b, x) / len(x), 18),
    "MEDIAN": median,
    "MIN": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "MOD": floor_mod,
    "NUMVAL": numval,
    "NUMVAL-C": lambda x: numval(x, currency=True),
    "ORD": lambda x: F.when(F.length(x) == 0, 0).otherwise(F.ascii(x) + 1),
    "REM": lambda a, b: a % b,
    "REVERSE": F.reverse,
    "SQRT": lambda x: F.sqrt(x).cast("decimal(38,16)"),
    "TRIM": F.trim,
    "TRIM-LEADING": F.ltrim,
    "TRIM-TRAILING": F.rtrim,
    "UPPER-CASE": F.upper,
    "WHEN-COMPILED": lambda: F.lit(datetime.now(UTC).strftime("%Y%m%d%H%M%S00+0000")),
}


def call(name: str, *arguments: Column) -> Column:
    try:
        return FUNCTIONS[name.upper()](*arguments)
    except KeyError:
        raise ValueError(f"no function {name}") from None
