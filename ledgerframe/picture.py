"""Pictures, fields and record layouts: plain Python, used when a plan is built.

A layout is a tree of fields with byte offsets, made by Layout.of() or from copybook text by Layout.from_copybook(). Spark types follow
from it; bytes are coded by sources.codec.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

DISPLAY, BINARY, PACKED = "DISPLAY", "BINARY", "PACKED"
#: Spellings of usages.
USAGES = {
    "DISPLAY": DISPLAY, "COMP": BINARY, "COMP-4": BINARY, "COMP-5": BINARY, "BINARY": BINARY, "COMPUTATIONAL": BINARY, "COMPUTATIONAL-4": BINARY,
    "COMPUTATIONAL-5": BINARY, "COMP-3": PACKED, "COMPUTATIONAL-3": PACKED, "PACKED-DECIMAL": PACKED,
}


@dataclass(frozen=True)
class Picture:
    text: str
    category: str  # alphabetic, alphanumeric, numeric, edited, national
    signed: bool
    whole: int
    decimals: int
    size: int
    scaling: int = 0  # digits of P: they count, but aren't stored

    @property
    def digits(self) -> int:
        return self.whole + self.decimals

    @property
    def numeric(self) -> bool:
        return self.category == "numeric"

    def spark_type(self) -> T.DataType:
        return T.DecimalType(max(self.digits, 1), self.decimals) if self.numeric else T.StringType()


def expand(text: str) -> str:
    """Upper-case, with repetition counts written out: 9(3)V99 is 999V99."""
    return re.sub(r"(CR|DB|.)\((\d+)\)", lambda m: m[1] * int(m[2]), text.strip().upper())


def picture(text: str) -> Picture:
    s = expand(text)
    if not s or re.search(r"[^AXNSVP9ZB0/,.+*$CRD-]", s):
        raise ValueError(f"not a picture: {text!r}")
    body, signed = s.removeprefix("S"), s.startswith("S")
    if re.fullmatch(r"N+", body):
        return Picture(text, "national", False, 0, 0, 2 * len(body))
    if re.fullmatch(r"A+", body):
        return Picture(text, "alphabetic", False, 0, 0, len(body))
    if re.fullmatch(r"[9VP]+", body):
        before, _, after = body.partition("V")
        scaling = body.count("P")
        return Picture(text, "numeric", signed, len(before), len(after), body.count("9"), scaling)
    if re.search(r"[AX]", body):
        return Picture(text, "alphanumeric" if re.fullmatch(r"[AX9]+", body) else "edited", False, 0, 0, len(body))
    # Edited numbers: 9, Z and * hold a digit; of a floating run of one sign the first symbol holds none.
    before, point, after = body.replace("V", ".", 1).partition(".") if "." in body or "V" in body else (body, "", "")
    floats = next((c for c in "$+-" if body.count(c) > 1), "")

    def held(part: str) -> int:
        return sum(part.count(c) for c in "9Z*") + (part.count(floats) if floats else 0)

    whole = held(before) - (1 if floats and floats in before else 0)
    return Picture(text, "edited", bool(re.search(r"[+-]|CR|DB", body)), whole, held(after), len(body.replace("V", "")))


@dataclass(frozen=True)
class Field:
    name: str
    pic: Picture | None = None  # None: a group
    usage: str = DISPLAY
    sign: str = "TRAILING"  # LEADING, TRAILING, LEADING SEPARATE, TRAILING SEPARATE
    occurs: int = 1
    depending: str | None = None
    redefines: str | None = None
    value: str | None = None
    conditions: tuple[tuple[str, tuple], ...] = ()  # level 88: name and values, a pair for THRU
    children: tuple[Field, ...] = ()
    offset: int = 0
    style: tuple[str, bool] = ("$", False)  # of edited numbers: the currency sign, and whether the decimal point is a comma

    @property
    def item_size(self) -> int:
        """Bytes of one occurrence."""
        if self.pic is None:
            return sum(c.size for c in self.children if not c.redefines)
        if self.usage == PACKED:
            return (self.pic.digits + 2) // 2
        if self.usage == BINARY:
            return 2 if self.pic.digits <= 4 else 4 if self.pic.digits <= 9 else 8
        return self.pic.size + ("SEPARATE" in self.sign and self.pic.numeric)

    @property
    def size(self) -> int:
        return self.item_size * self.occurs

    def spark_type(self) -> T.DataType:
        one = T.StructType([T.StructField(c.name, c.spark_type()) for c in self.children if c.name != "FILLER"]) if self.pic is None else self.pic.spark_type()
        return T.ArrayType(one) if self.occurs > 1 else one


@dataclass(frozen=True)
class Layout:
    name: str
    fields: tuple[Field, ...] = field(default=())

    @staticmethod
    def of(name: str, *fields: Field) -> Layout:
        def placed(items: tuple[Field, ...], at: int) -> tuple[tuple[Field, ...], int]:
            out: list[Field] = []
            for f in items:
                start = next((o.offset for o in out if o.name == f.redefines), at) if f.redefines else at
                children, _ = placed(f.children, start)
                out.append(replace(f, offset=start, children=children))
                at = max(at, start + out[-1].size)  # a redefinition may be longer than what it redefines
            return tuple(out), at

        return Layout(name, placed(fields, 0)[0])

    @property
    def size(self) -> int:
        return max((f.offset + f.size for f in self.fields), default=0)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields if f.name != "FILLER"])

    def walk(self) -> Iterator[Field]:
        def down(fields: tuple[Field, ...]) -> Iterator[Field]:
            for f in fields:
                yield f
                yield from down(f.children)

        yield from down(self.fields)

    def field(self, name: str) -> Field:
        return next(f for f in self.walk() if f.name == name.upper().replace("-", "_"))

    @staticmethod
    def from_copybook(text: str) -> Layout:
        """Data description entries to a layout: groups, PIC, USAGE, SIGN, OCCURS (DEPENDING ON), REDEFINES, VALUE, levels 88 and 77."""
        lines = [ln[6:72] if re.match(r"^(\d{6}| {6})([ */-]|D(?= ))", ln) else ln for ln in text.splitlines()]
        source = " ".join(ln for ln in lines if not ln.lstrip().startswith("*"))
        entries = re.findall(r"\s*(\d\d)\s+((?:'[^']*'|\"[^\"]*\"|[^.'\"]|\.(?=\S))+)\.(?=\s|$)", source)
        root: list = [0, "", [], {}]
        stack = [root]
        for level_text, body in entries:
            level = int(level_text)
            words = re.findall(r"'[^']*'|\"[^\"]*\"|(?:[^\s,]|,(?=[^\s'\"]))+", body)
            name = words[0].upper().replace("-", "_")
            if level == 88:
                values, rest = [], [w for w in words[1:] if w.upper() not in ("VALUE", "VALUES", "IS", "ARE")]
                while rest:
                    v = rest.pop(0).strip("'\"")
                    if rest and rest[0].upper() in ("THRU", "THROUGH"):
                        v = (v, rest[1].strip("'\""))
                        del rest[:2]
                    values.append(v)
                stack[-1][3].setdefault("conditions", []).append((name, tuple(values)))
                continue
            if level == 66:
                raise ValueError("level 66 isn't supported")
            up, options = [w.upper() for w in words], {}
            for i, w in enumerate(up):
                after = lambda n=i: up[n + 2] if up[n + 1] == "IS" else up[n + 1]
                if w in ("PIC", "PICTURE"):
                    options["pic"] = picture(after())
                elif w in USAGES:
                    options["usage"] = USAGES[w]
                elif w == "OCCURS":
                    options["occurs"] = int(up[i + 3] if up[i + 2 : i + 3] == ["TO"] else up[i + 1])
                elif w == "DEPENDING":
                    options["depending"] = (up[i + 2] if up[i + 1] == "ON" else up[i + 1]).replace("-", "_")
                elif w == "REDEFINES":
                    options["redefines"] = up[i + 1].replace("-", "_")
                elif w in ("LEADING", "TRAILING"):
                    options["sign"] = w + (" SEPARATE" if up[i + 1 : i + 2] == ["SEPARATE"] else "")
                elif w == "VALUE":
                    options["value"] = (words[i + 2] if up[i + 1] == "IS" else words[i + 1]).strip("'\"")
            while stack[-1][0] >= level and len(stack) > 1:
                stack.pop()
            if level == 77:
                del stack[1:]
            node = [level, name, [], options]
            stack[-1][2].append(node)
            stack.append(node)

        def made(node: list) -> Field:
            options = dict(node[3])
            options["conditions"] = tuple(options.get("conditions", ()))
            return Field(node[1], children=tuple(map(made, node[2])), **options)

        top = root[2]
        if len(top) == 1 and "pic" not in top[0][3] and top[0][3].get("occurs", 1) == 1:
            return Layout.of(top[0][1], *map(made, top[0][2]))
        return Layout.of("RECORD", *map(made, top))
