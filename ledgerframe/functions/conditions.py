"""Class and sign conditions, level 88 conditions, comparisons of text and EVALUATE."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..picture import Field
from ..sources import codec


def is_numeric(x: Column) -> Column:
    return F.regexp_like(x, F.lit("^[0-9.+-]*$"))


def is_alphabetic(x: Column) -> Column:
    return F.regexp_like(x, F.lit("^[A-Za-z ]*$"))


def is_positive(x: Column) -> Column:
    return x > 0


def is_negative(x: Column) -> Column:
    return x < 0


def is_zero(x: Column) -> Column:
    return x == 0


def equal_text(a: Column, b: Column) -> Column:
    """Equality as if the shorter were padded with blanks."""
    return F.rtrim(a) == F.rtrim(b)


def compare_text(a: Column, b: Column, relation: str, encoding: str | None = None) -> Column:
    """Text compared as if the shorter were padded with blanks, by code points or, with an EBCDIC code page, by its order of characters."""
    n = F.greatest(F.length(a), F.length(b))
    a, b = F.rpad(a, n, " "), F.rpad(b, n, " ")
    if encoding:
        a, b = (codec.ebcdic_key(x, encoding) for x in (a, b))
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[relation]


def with_condition(field: Field, name: str, test: Callable[[Column], Column]) -> Field:
    """The field with one more condition, which is a function of its value."""
    return replace(field, conditions=(*field.conditions, (name.upper().replace("-", "_"), (test,))))


def level88(field: Field, name: str, x: Column) -> Column:
    """The field's condition of that name: any of its values or ranges, or a function; numbers by value, text padded with blanks."""
    values = dict(field.conditions)[name.upper().replace("-", "_")]
    if callable(values[0]):
        return values[0](x)
    number = field.pic is not None and field.pic.numeric
    lit = lambda v: F.lit(v).cast("decimal(38,10)") if number else F.lit(v)
    test = lambda v: x.between(lit(v[0]), lit(v[1])) if isinstance(v, tuple) else x == lit(v) if number else equal_text(x, lit(v))
    out = test(values[0])
    for v in values[1:]:
        out = out | test(v)
    return out


def evaluate(subject: Column | None, *branches: tuple[object, object], other: object = None) -> Column:
    """EVALUATE: branches (what, result), what a value, a pair (low, high), a list of such or, without subject, a condition."""

    def test(what: object) -> Column:
        if isinstance(what, list):
            out = test(what[0])
            for w in what[1:]:
                out = out | test(w)
            return out
        if subject is None:
            return what
        return subject.between(*map(F.lit, what)) if isinstance(what, tuple) else subject == F.lit(what)

    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(test(branches[0][0]), as_column(branches[0][1]))
    for what, result in branches[1:]:
        out = out.when(test(what), as_column(result))
    return out.otherwise(as_column(other))
