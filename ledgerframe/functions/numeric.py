"""Exact decimal rules: truncation, rounding, MOVE, storing with size errors, DIVIDE with remainder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..picture import Picture, picture


def _pic(p: Picture | str) -> Picture:
    return picture(p) if isinstance(p, str) else p


def truncated(x: Column, decimals: int) -> Column:
    """x without what is beyond so many decimals, toward zero."""
    return F.when(x >= 0, F.floor(x, F.lit(decimals))).otherwise(F.ceil(x, F.lit(decimals)))


def fitted(x: Column, pic: Picture | str, rounded: bool = False) -> Column:
    p = _pic(pic)
    return F.round(x, p.decimals) if rounded else truncated(x, p.decimals)


def size_error(x: Column, pic: Picture | str, rounded: bool = False) -> Column:
    """True where x, fitted to the picture's decimals, has more digits before the point than the picture; also for null (÷ 0)."""
    p = _pic(pic)
    limit = F.lit("1" + "0" * p.whole).cast(f"decimal({p.whole + 1},0)")
    return F.coalesce(F.abs(fitted(x, p, rounded)) >= limit, F.lit(True))


def stored(x: Column, pic: Picture | str, old: Column | None = None, rounded: bool = False, on_error: Callable[[Column], Column] | None = None) -> Column:
    """What a field of the picture holds after an arithmetic statement: on a size error its old value (null if none is given).

    on_error: what it holds then instead, a function of the result that doesn't fit.
    """
    p = _pic(pic)
    old = on_error(x) if on_error else old
    y = fitted(x, p, rounded)
    y = y if p.signed else F.abs(y)
    return F.when(size_error(x, p, rounded), old if old is not None else F.lit(None)).otherwise(y).cast(f"decimal({max(p.digits, 1)},{p.decimals})")


def moved(x: Column, pic: Picture | str) -> Column:
    """MOVE of a number: decimals and high-order digits beyond the picture are dropped; an unsigned field drops the sign."""
    p = _pic(pic)
    limit = F.lit("1" + "0" * p.whole).cast(f"decimal({p.whole + 1},0)")
    y = truncated(x, p.decimals) % limit
    return (y if p.signed else F.abs(y)).cast(f"decimal({max(p.digits, 1)},{p.decimals})")


def numeric_text(x: Column, wide: str = "decimal(38,10)") -> Column:
    """MOVE of text to a number, before fitting: trimmed, and 0 where it isn't a number."""
    return F.coalesce(F.trim(x).try_cast(wide), F.lit(0).cast(wide))


def quotient(a: Column, b: Column, decimals: int, scale: int = 5) -> Column:
    """a / b with scale more decimals than are kept, truncated; null where b is 0."""
    return truncated(F.try_divide(a, b), decimals + scale)


def divided(a: Column, b: Column, pic: Picture | str, rounded: bool = False) -> tuple[Column, Column]:
    """Quotient and remainder of DIVIDE ... GIVING ... REMAINDER; the remainder is of the truncated quotient. Null where b is 0."""
    p = _pic(pic)
    q = quotient(a, b, p.decimals)
    return stored(q, p, rounded=rounded), a - truncated(q, p.decimals) * b


def tracked(df: DataFrame, log: str = "changes", **sets: Column) -> DataFrame:
    """df with columns set, and a log of what that changed in each row: an array of (field, old, new) as text, added to what is there."""
    text = lambda c: c.cast("string")
    entries = [F.struct(F.lit(n).alias("field"), (text(F.col(n)) if n in df.columns else F.lit(None).cast("string")).alias("old"), text(c).alias("new")) for n, c in sets.items()]
    made = F.filter(F.array(*entries), lambda e: ~e["old"].eqNullSafe(e["new"]))
    return df.withColumns({log: F.concat(F.col(log), made) if log in df.columns else made, **sets})


def power(x: Column, n: int) -> Column:
    """x to a whole exponent that is known when the plan is built."""
    return F.lit(1) if n == 0 else reduce(lambda a, b: a * b, [x] * n) if n > 0 else F.try_divide(F.lit(1), power(x, -n))


def median(*xs: Column) -> Column:
    """The exact middle of the arguments, or the mean of the middle two."""
    a = F.array_sort(F.array(*xs))
    n = len(xs)
    return a[n // 2] if n % 2 else (a[n // 2 - 1] + a[n // 2]) / 2


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return a - b * F.floor(F.try_divide(a, b))
