"""STRING, UNSTRING, INSPECT, reference modification and MOVE of text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(x: Column, size: int) -> Column:
    """MOVE of text: left-justified, blanks to the right, cut at the size."""
    return F.rpad(F.coalesce(x, F.lit("")), size, " ")


def part(x: Column, start: int | Column, length: int | Column) -> Column:
    """Reference modification x(start:length), from 1."""
    return F.substring(x, start, length)


def overlaid(x: Column, value: Column, start: int | Column, length: int) -> Column:
    """x with the part (start:length) replaced by value, padded or cut to the length."""
    return F.overlay(x, padded(value, length), start, F.lit(length))


def delimited(x: Column, delimiter: str | None) -> Column:
    """What STRING takes of a sender: all (None: SIZE), or what stands before the delimiter."""
    return x if delimiter is None else F.substring_index(x, delimiter, 1)


def string(target: Column, size: int, *senders: tuple[Column, str | None], pointer: int | Column = 1) -> tuple[Column, Column, Column]:
    """STRING senders INTO target WITH POINTER: the target, the pointer after it, and whether it overflowed.

    Characters of the target that aren't written stay.
    """
    start = F.lit(pointer) if isinstance(pointer, int) else pointer
    text = F.concat(*(delimited(F.coalesce(x, F.lit("")), d) for x, d in senders))
    room = F.greatest(F.lit(size) - start + 1, F.lit(0))
    valid = (start >= 1) & (start <= size)
    written = F.substring(text, F.lit(1), room)
    out = F.when(valid & (F.length(written) > 0), F.overlay(padded(target, size), written, start)).otherwise(padded(target, size))
    return out, F.when(valid, start + F.length(written)).otherwise(start), ~valid | (F.length(text) > room)


def _pattern(delimiters: tuple[str, ...], all_: bool) -> str:
    return "|".join(f"(?:{re.escape(d)}){'+' if all_ else ''}" for d in delimiters)


def unstring(x: Column, n: int, *delimiters: str, all_: bool = False) -> tuple[Column, Column, Column]:
    """UNSTRING x into n fields: the fields (null: not reached), the delimiters found after them, and whether text is left over."""
    rule = _pattern(delimiters, all_)
    pieces = F.split(x, rule, -1)
    return F.slice(F.concat(pieces, F.array_repeat(F.lit(None).cast("string"), n)), 1, n), F.slice(F.regexp_extract_all(x, F.lit(rule), F.lit(0)), 1, n), F.size(pieces) > n


def unstring_from(x: Column, n: int, *delimiters: str, all_: bool = False, pointer: int | Column = 1) -> tuple[Column, Column, Column, Column]:
    """UNSTRING WITH POINTER: the fields, the delimiters, the pointer after what was taken, and whether it overflowed.

    A pointer outside of x overflows and changes nothing. Text that is left over is what stands from the new pointer on.
    """
    start = F.lit(pointer) if isinstance(pointer, int) else pointer
    valid = (start >= 1) & (start <= F.length(x))
    rest = F.substring(x, start, F.length(x))
    got, found, over = unstring(rest, n, *delimiters, all_=all_)
    size = lambda a: F.aggregate(a, F.lit(0), lambda t, v: t + F.coalesce(F.length(v), F.lit(0)))
    after = F.when(over, start + size(got) + size(found)).otherwise(F.length(x) + 1)
    none = F.array_repeat(F.lit(None).cast("string"), n)
    return F.when(valid, got).otherwise(none), F.when(valid, found).otherwise(F.slice(none, 1, 0)), F.when(valid, after).otherwise(start), ~valid | over


def scope(x: Column, before: str | None = None, after: str | None = None) -> tuple[Column, Column, Column]:
    """x in three: what an INSPECT leaves alone, its scope, and the rest. AFTER what isn't found: no scope; BEFORE: to the end."""
    start = F.lit(0)
    if after is not None:
        at = F.instr(x, after)
        start = F.when(at > 0, at + len(after) - 1).otherwise(F.length(x))
    rest = F.substring(x, start + 1, F.length(x))
    stop = F.lit(0) if before is None else F.instr(rest, before)
    middle = rest if before is None else F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)
    return F.substring(x, F.lit(1), start), middle, F.substring(rest, F.length(middle) + 1, F.length(rest))


def tally(x: Column, kind: str, what: str = "", before: str | None = None, after: str | None = None) -> Column:
    """INSPECT TALLYING: ALL what, LEADING what, or CHARACTERS."""
    s = scope(x, before, after)[1]
    if kind == "CHARACTERS":
        return F.length(s)
    if kind == "ALL":
        return F.regexp_count(s, F.lit(re.escape(what)))
    return (F.length(F.regexp_extract(s, f"^((?:{re.escape(what)})*)", 1)) / len(what)).cast("int")


def replaced(x: Column, kind: str, old: str, new: str, before: str | None = None, after: str | None = None) -> Column:
    """INSPECT REPLACING: ALL, LEADING or FIRST old BY new, of equal length; kind CHARACTERS: each character by new."""
    a, s, z = scope(x, before, after)
    if kind == "ALL":
        s = F.replace(s, F.lit(old), F.lit(new))
    elif kind == "CHARACTERS":
        s = F.repeat(F.lit(new), F.length(s))
    elif kind == "FIRST":
        s = F.when(F.instr(s, old) > 0, F.overlay(s, F.lit(new), F.instr(s, old))).otherwise(s)
    else:
        n = F.length(F.regexp_extract(s, f"^((?:{re.escape(old)})*)", 1))
        s = F.concat(F.repeat(F.lit(new), (n / len(old)).cast("int")), F.substring(s, n + 1, F.length(s)))
    return F.concat(a, s, z)


def inspected(x: Column, converting: tuple[str, str] | None = None, replacing: tuple[tuple[str, str, str], ...] = (), change: Callable[[Column], Column] | None = None, before: str | None = None, after: str | None = None) -> Column:
    """Several rules in one INSPECT: CONVERTING first, then REPLACING rules (kind, old, new) in order, then a function of each character."""
    out = converted(x, *converting, before, after) if converting else x
    for kind, old, new in replacing:
        out = replaced(out, kind, old, new, before, after)
    if change is None:
        return out
    a, s, z = scope(out, before, after)
    return F.concat(a, F.array_join(F.transform(F.split(s, ""), change), ""), z)


def converted(x: Column, old: str, new: str, before: str | None = None, after: str | None = None) -> Column:
    """INSPECT CONVERTING: each character of old by the one at its place in new; the first of repeated ones counts."""
    pairs = {}
    for a, b in zip(old, new):
        pairs.setdefault(a, b)
    a, s, z = scope(x, before, after)
    return F.concat(a, F.translate(s, "".join(pairs), "".join(pairs.values())), z)
