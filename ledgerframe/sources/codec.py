"""Bytes of fixed records to columns and back, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..picture import BINARY, PACKED, Field, Layout
from ..functions.numeric import moved

#: The last digit of a signed zoned number, + and then -.
OVERPUNCH = "{ABCDEFGHI", "}JKLMNOPQR"


def code_page(name: str) -> tuple[str, str]:
    """Latin-1 characters of EBCDIC bytes, and what each stands for, where they differ; cp1047 is cp037 with its six swaps."""
    table = list(bytes(range(256)).decode("cp500" if name == "cp500" else "cp037"))
    if name == "cp1047":
        for code, c in {0x5F: "^", 0xAD: "[", 0xB0: "¬", 0xBA: "Ý", 0xBB: "¨", 0xBD: "]"}.items():
            table[code] = c
    pairs = [(chr(i), c) for i, c in enumerate(table) if chr(i) != c and c != "\x00"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def to_text(data: Column, encoding: str | None = None) -> Column:
    s = F.decode(data, "ISO-8859-1")
    return F.translate(s, *code_page(encoding)) if encoding else s


def to_bytes(text: Column, encoding: str | None = None) -> Column:
    if encoding:
        a, b = code_page(encoding)
        text = F.translate(text, b, a)
    return F.encode(text, "ISO-8859-1")


def ebcdic_key(text: Column, encoding: str = "cp037") -> Column:
    """Sort key by EBCDIC order: binary compares unsigned."""
    return to_bytes(text, encoding)


def _unscaled(digits: Column, negative: Column, f: Field) -> Column:
    p = f.pic
    number = F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    number = F.when(negative, -number).otherwise(number)
    wide = number.cast(f"decimal(38,{p.decimals})") if not p.decimals else (number * F.lit("0." + "0" * (p.decimals - 1) + "1").cast(f"decimal({p.decimals},{p.decimals})"))
    return wide.cast(p.spark_type())


def decoded(data: Column, f: Field, encoding: str | None = None) -> Column:
    """One occurrence of an elementary field from its bytes; blank or invalid numbers are 0."""
    p = f.pic
    if p.category == "national":
        return F.decode(data, "UTF-16BE")
    if not p.numeric:
        return to_text(data, encoding)
    if f.usage == PACKED:
        h = F.hex(data)
        return _unscaled(F.substring(h, 1, 2 * f.item_size - 1), F.right(h, F.lit(1)) == "D", f)
    if f.usage == BINARY:
        n = f.item_size
        unsigned = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
        top = F.substring(F.hex(data), 1, 1) >= "8"
        number = F.when(top, unsigned - F.lit(str(1 << 8 * n)).cast("decimal(20,0)")).otherwise(unsigned)
        return _unscaled(F.abs(number).cast("string"), number < 0, f)
    s = to_text(data, encoding)
    if "SEPARATE" in f.sign:
        sign = F.substring(s, 1, 1) if f.sign.startswith("LEADING") else F.right(s, F.lit(1))
        digits = F.substring(s, 2, p.size) if f.sign.startswith("LEADING") else F.substring(s, 1, p.size)
        return _unscaled(F.trim(digits), sign == "-", f)
    if not p.signed:
        return _unscaled(F.trim(s), F.lit(False), f)
    plus, minus = OVERPUNCH
    at = F.substring(s, 1, 1) if f.sign == "LEADING" else F.right(s, F.lit(1))
    digit = F.translate(at, plus + minus, "0123456789" * 2)
    digits = F.concat(digit, F.substring(s, 2, p.size)) if f.sign == "LEADING" else F.concat(F.substring(s, 1, p.size - 1), digit)
    return _unscaled(F.trim(digits), F.instr(F.lit(minus), at) > 0, f)


def encoded(x: Column, f: Field, encoding: str | None = None) -> Column:
    """The bytes of one occurrence of an elementary field; numbers are moved to the picture first."""
    p = f.pic
    if p.category == "national":
        return F.encode(F.rpad(F.coalesce(x, F.lit("")), p.size // 2, " "), "UTF-16BE")
    if not p.numeric:
        return to_bytes(F.rpad(F.coalesce(x, F.lit("")), p.size, " "), encoding)
    number = F.coalesce(moved(x, p), F.lit(0).cast(p.spark_type()))
    unscaled = (F.abs(number) * F.lit(10**p.decimals).cast("decimal(19,0)")).cast("decimal(38,0)")
    negative = number < 0
    if f.usage == PACKED:
        digits = F.lpad(unscaled.cast("string"), 2 * f.item_size - 1, "0")
        return F.unhex(F.concat(digits, F.when(negative, "D").otherwise("C") if p.signed else F.lit("F")))
    if f.usage == BINARY:
        signed = F.when(negative, -unscaled).otherwise(unscaled).cast("long")
        return F.unhex(F.right(F.lpad(F.hex(signed), 16, "0"), F.lit(2 * f.item_size)))
    s = F.lpad(unscaled.cast("string"), p.size, "0")
    if "SEPARATE" in f.sign:
        sign = F.when(negative, "-").otherwise("+")
        s = F.concat(sign, s) if f.sign.startswith("LEADING") else F.concat(s, sign)
    elif p.signed:
        plus, minus = OVERPUNCH
        at = F.substring(s, 1, 1) if f.sign == "LEADING" else F.right(s, F.lit(1))
        punched = F.when(negative, F.translate(at, "0123456789", minus)).otherwise(F.translate(at, "0123456789", plus))
        s = F.concat(punched, F.substring(s, 2, p.size)) if f.sign == "LEADING" else F.concat(F.substring(s, 1, p.size - 1), punched)
    return to_bytes(s, encoding)


def _value(data: Column, f: Field, encoding: str | None, base: Column | int) -> Column:
    def one(at: Column) -> Column:
        if f.pic is None:
            return F.struct(*(_value(data, c, encoding, at - f.offset).alias(c.name) for c in f.children if c.name != "FILLER"))
        return decoded(F.substring(data, at + 1, F.lit(f.item_size)), f, encoding)

    start = F.lit(f.offset) + base
    if f.occurs == 1:
        return one(start)
    items = F.transform(F.sequence(F.lit(0), F.lit(f.occurs - 1)), lambda i: one(start + i * f.item_size))
    return items


def records(df: DataFrame, layout: Layout, column: str = "value", encoding: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a layout from a binary column, after those to keep; a table of varying length is cut at its counter."""
    out = df.select(*keep, *(_value(F.col(column), f, encoding, 0).alias(f.name) for f in layout.fields if f.name != "FILLER"))
    for f in layout.fields:
        if f.depending and f.depending in out.columns:
            out = out.withColumn(f.name, F.slice(F.col(f.name), F.lit(1), F.greatest(F.col(f.depending).cast("int"), F.lit(0))))
    return out


def _bytes(x: Column, f: Field, encoding: str | None) -> Column:
    def one(v: Column) -> Column:
        if f.pic is None:
            return F.concat(*(_bytes(v[c.name] if c.name != "FILLER" else F.lit(None), c, encoding) for c in f.children if not c.redefines))
        if f.name == "FILLER":
            return to_bytes(F.lit(" " * f.item_size), encoding)
        return encoded(v, f, encoding)

    if f.occurs == 1:
        return one(x)
    return F.concat(*(one(F.get(x, F.lit(i))) for i in range(f.occurs)))


def to_records(df: DataFrame, layout: Layout, column: str = "value", encoding: str | None = None) -> DataFrame:
    """One binary column of the layout's size from columns named as its fields."""
    return df.select(F.concat(*(_bytes(F.col(f.name) if f.name != "FILLER" else F.lit(None), f, encoding) for f in layout.fields if not f.redefines)).alias(column))
