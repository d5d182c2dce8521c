"""Numeric-edited pictures: a number to its display form and back, as one expression for each position of the picture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..picture import expand, picture
from .numeric import truncated


def edited(x: Column, pic: str, currency: str = "$", decimal_comma: bool = False) -> Column:
    """x in an edited picture: Z and * suppression, fixed and floating $ + -, insertion of , . / B 0, trailing CR DB + -.

    Digits beyond the picture are dropped on both sides. In the suppressed part commas go, too: to the fill, or to nothing before a
    floating sign.
    """
    p, s = picture(pic), expand(pic)
    tail = next((t for t in ("CR", "DB") if s.endswith(t)), "")
    s = s.removesuffix(tail)
    floats = next((c for c in "$+-" if s.count(c) > 1), "")
    unscaled = truncated(F.abs(x), p.decimals) * F.lit(10**p.decimals).cast("decimal(38,0)") if p.decimals else truncated(F.abs(x), 0)
    raw = unscaled.cast("decimal(38,0)").cast("string")
    digits = F.lpad(F.right(raw, F.lit(max(p.digits, 1))), max(p.digits, 1), "0")
    negative = x < 0
    sign = {"$": F.lit(currency), "+": F.when(negative, "-").otherwise("+"), "-": F.when(negative, "-").otherwise(" ")}
    fill = "*" if "*" in s else " "
    at, seen, parts, forced = 0, False, [], False
    first_nonzero = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))  # digits before the first that isn't 0
    for c in s:
        if c in "9Z*" or c == floats and seen:
            digit = F.substring(digits, at + 1, 1)
            forced = forced or c == "9"
            # A suppressed digit shows once a digit before it, or itself, isn't 0.
            parts.append(digit if forced else F.when(F.lit(at) >= first_nonzero, digit).otherwise(F.lit("\x00")))
            at += 1
        elif c == floats:
            seen = True  # the first of a floating run holds no digit
            parts.append(F.lit("\x00"))
        elif c in "$+-":
            parts.append(sign[c])
        elif c == ".":
            forced = True
            parts.append(F.lit("."))
        elif c == "V":
            forced = True
        else:
            shown = {",": ",", "/": "/", "B": " ", "0": "0"}[c]
            parts.append(F.lit(shown) if forced or c != "," else F.when(F.lit(at) > first_nonzero, shown).otherwise(F.lit("\x00")))
    out = F.concat(*parts)
    if floats:  # the sign stands before what is shown; blanks before it
        shown = F.replace(out, F.lit("\x00"), F.lit(""))
        out = F.lpad(F.concat(sign[floats], shown), len(s.replace("V", "")), " ")
    else:
        out = F.replace(out, F.lit("\x00"), F.lit(fill))
    if tail:
        out = F.concat(out, F.when(negative, tail).otherwise("  "))
    return F.translate(out, ".,", ",.") if decimal_comma else out


def plain(text: Column, pic: str, decimal_comma: bool = False) -> Column:
    """The number that an edited form shows; 0 where it shows none."""
    p = picture(pic)
    s = F.translate(text, ".,", ",.") if decimal_comma else text
    number = F.regexp_replace(s, "[^0-9.]", "").try_cast(f"decimal({max(p.digits, 1)},{p.decimals})")
    return F.coalesce(F.when(F.regexp_like(s, F.lit("-|CR|DB")), -number).otherwise(number), F.lit(0)).cast(f"decimal({max(p.digits, 1)},{p.decimals})")
