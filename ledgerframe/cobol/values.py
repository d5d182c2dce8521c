"""Values while a program is lowered: known ones are computed here, on the driver; the others are Columns and stay expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal, InvalidOperation, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import edited, numeric, strings
from ..functions.moves import FIGURATIVE
from ..picture import Field

WIDE = "decimal(38,10)"


@dataclass(frozen=True)
class V:
    value: Decimal | str | bool | Column | None
    number: bool = False
    field: Field | None = None

    @property
    def known(self) -> bool:
        return not isinstance(self.value, Column)


def column(v: V) -> Column:
    if not v.known:
        return v.value
    if v.number and v.value is not None:
        return F.lit(v.value)
    return F.lit(v.value).cast(WIDE) if v.number else F.lit(v.value)


def number(v: V) -> V:
    """A number: text is trimmed and parsed, 0 where it isn't one."""
    if v.number:
        return v
    shown = v.field is not None and v.field.pic is not None and v.field.pic.category == "edited"
    if not v.known:
        return V(edited.plain(v.value, v.field.pic.text, v.field.style[1]) if shown else numeric.numeric_text(v.value), True)
    t = v.value
    if shown:  # what an edited number shows
        t = t.translate(str.maketrans(".,", ",.")) if v.field.style[1] else t
        t = ("-" if re.search("-|CR|DB", t) else "") + (re.sub("[^0-9.]", "", t) or "0")
    try:
        out = Decimal(t.strip() or "0")
    except InvalidOperation:
        out = Decimal(0)
    return V(out if out.is_finite() else Decimal(0), True)


def plain(x: Decimal) -> str:
    return f"{x:f}"


def text(v: V) -> V:
    """As text: a numeric DISPLAY field by its digits, other numbers plainly."""
    if not v.number:
        return v
    whole = v.field.pic if v.field and v.field.pic and v.field.pic.numeric else None
    if v.known:
        if whole is None:
            return V(plain(v.value))
        return V(("-" if v.value < 0 else "") + str(int(abs(v.value).scaleb(whole.decimals))).rjust(whole.digits, "0"))
    if whole is None:
        return V(v.value.cast("string"))
    unscaled = (F.abs(v.value).cast(f"decimal(38,{whole.decimals})") * F.lit(Decimal(10**whole.decimals))).cast("decimal(38,0)").cast("string")
    return V(F.concat(F.when(v.value < 0, "-").otherwise(""), F.lpad(unscaled, whole.digits, "0")))


def shown(v: V) -> V:
    """As DISPLAY shows it: numbers with their point."""
    return V(plain(v.value)) if v.number and v.known else V(v.value.cast("string")) if v.number else v


def arithmetic(op: str, a: V, b: V) -> V:
    """+ - * / **; a quotient has ten decimals, rounded half up; null (a size error) for a division by zero."""
    a, b = number(a), number(b)
    if a.known and b.known:
        if a.value is None or b.value is None:
            return V(None, True)
        with localcontext() as c:
            c.prec = 80
            if op == "/":
                return V(None if b.value == 0 else (a.value / b.value).quantize(Decimal("1e-10"), ROUND_HALF_UP), True)
            if op == "**":
                return V(a.value ** b.value, True)
            return V(a.value + b.value if op == "+" else a.value - b.value if op == "-" else a.value * b.value, True)
    x, y = column(a), column(b)
    if op == "/":
        return V(F.round(F.try_divide(x, y), 10), True)
    if op == "**":
        if not b.known or b.value != int(b.value):
            raise ValueError("** takes a whole exponent that is known when the plan is built")
        return V(numeric.power(x, int(b.value)), True)
    return V(x + y if op == "+" else x - y if op == "-" else x * y, True)


def stored(v: V, field: Field, old: V, rounded: bool = False) -> tuple[V, V]:
    """What an arithmetic statement leaves in a field, and whether it was a size error (the field stays)."""
    p, v = field.pic, number(v)
    if p.category == "edited":
        return moved(v, field), V(False)
    if v.known and old.known:
        if v.value is None:
            return old, V(True)
        x = v.value.quantize(Decimal(1).scaleb(-p.decimals), ROUND_HALF_UP if rounded else ROUND_DOWN)
        if abs(x) >= 10**p.whole:
            return old, V(True)
        return V(x if p.signed else abs(x), True, field), V(False)
    return V(numeric.stored(column(v), p, column(old), rounded), True, field), V(numeric.size_error(column(v), p, rounded))


def moved(v: V, field: Field) -> V:
    """MOVE to an elementary field."""
    p = field.pic
    if p.numeric:
        v = number(v)
        if v.known:
            x = v.value.quantize(Decimal(1).scaleb(-p.decimals), ROUND_DOWN)
            x = (abs(x) % 10**p.whole).copy_sign(x) + 0
            return V(x if p.signed else abs(x), True, field)
        return V(numeric.moved(v.value, p), True, field)
    if p.category == "edited" and not set("AX") & set(p.text.upper()):
        v = number(v)
        return V(edited.edited(column(v).cast(f"decimal(38,{max(p.decimals, 0) + 2})"), p.text, *field.style), False, field)
    t = text(v)
    size = p.size // 2 if p.category == "national" else p.size
    return V(t.value[:size].ljust(size) if t.known else strings.padded(t.value, size), False, field)


def filled(constant: str, field: Field) -> V:
    if field.pic.numeric:
        return V(Decimal(0).quantize(Decimal(1).scaleb(-field.pic.decimals)), True, field)
    return V(FIGURATIVE[constant] * field.pic.size, False, field)


def compared(op: str, a: V, b: V) -> V:
    """Numbers by value; text as if the shorter were padded with blanks."""
    if a.number or b.number:
        a, b = number(a), number(b)
        x, y = (a.value, b.value) if a.known and b.known else (column(a), column(b))
    elif a.known and b.known:
        n = max(len(a.value), len(b.value))
        x, y = a.value.ljust(n), b.value.ljust(n)
    else:
        x, y = F.rtrim(column(a)), F.rtrim(column(b))
    return V({"=": lambda: x == y, "<>": lambda: x != y, ">": lambda: x > y, "<": lambda: x < y, ">=": lambda: x >= y, "<=": lambda: x <= y}[op]())


def both(a: V, b: V) -> V:
    if a.known:
        return b if a.value else V(False)
    return a if b.known and b.value else V(False) if b.known else V(a.value & b.value)


def either(a: V, b: V) -> V:
    if a.known:
        return V(True) if a.value else b
    return (V(True) if b.value else a) if b.known else V(a.value | b.value)


def negated(a: V) -> V:
    return V(not a.value) if a.known else V(~a.value)


def chosen(c: V, a: V, b: V) -> V:
    if a is b or a.known and b.known and a == b:
        return a
    return V(F.when(column(c), column(a)).otherwise(column(b)), a.number and b.number, a.field or b.field)
