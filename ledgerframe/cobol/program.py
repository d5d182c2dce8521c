"""Programs: data division to layouts, statements outside of loops run on the driver, reading loops lowered to DataFrame plans.

A loop over READ (or FETCH, or RETURN) becomes one plan when its body fits: fields set before they are read in each pass are expressions,
ADD and SUBTRACT into a field that the body doesn't read are sums, IF x > m MOVE x TO m is a maximum, WRITE and DISPLAY are projections,
a keyed READ is a left join. A field that is read before it is set, and set anew for each record, holds what the record before has left
(a previous key): records meet their predecessors by an equality join on their numbers. A sum is of the values cut to the field's decimals; where it doesn't fit into its field, or where a body
depends on the order of records in another way, the loop runs record by record on the driver, and a diagnostic says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import conditions, intrinsics, moves, numeric, strings
from ..operators import records
from ..picture import Field, Layout, picture
from ..sources import files, folders
from ..sql import Session
from . import source, values
from .syntax import Parser, UnsupportedVerbError, paragraphs
from .values import V, column

__all__ = ["Diagnostic", "Program", "UnsupportedVerbError", "run"]


@dataclass(frozen=True)
class Diagnostic:
    level: str  # INFO, WARNING, ERROR
    text: str


class Ordered(Exception):
    """The loop depends on the order of its records beyond what a plan can say."""


class Unset(Ordered):
    """A pass reads a field before it sets it: what the record before has left there."""

    def __init__(self, name: str):
        super().__init__(f"{name} is read before it is set")
        self.name = name


class Stop(Exception):
    pass


class Leave(Exception):
    pass


class Jump(Exception):
    """GO TO a paragraph."""

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class LeaveLoop(Exception):
    pass


class Cycle(Exception):
    pass


@dataclass
class File:
    name: str
    assign: str
    organization: str = "SEQUENTIAL"
    key: str | None = None
    record: str = ""
    layout: Layout | None = None
    mode: str = ""
    data: DataFrame | None = None
    rows: Iterator | None = None
    reads: int = 0
    chunks: list = field(default_factory=list)
    status: str = ""
    at: DataFrame | None = None  # the records from START's position on
    changes: dict = field(default_factory=dict)  # by key or rrn: the record that a statement on the driver left, null if deleted
    dirty: bool = False
    last: object = None  # rrn of the record that was read last
    numbered: bool = False  # whether rrn is the record's place in the file, without gaps

    def show(self) -> str:
        return self.name.replace("_", "-")


def _sections(text: str, *names: str) -> dict[str, str]:
    cut = re.split(rf"\b({'|'.join(names)})\s*(?:\.|\bUSING\b)", text, flags=re.IGNORECASE)
    return {re.sub(r"\s+", " ", k.upper()): v for k, v in zip(cut[1::2], cut[2::2])}


class Program:
    def __init__(self, text: str, folders: list[str] | None = None):
        self.text = source.expanded(source.plain(text), folders or ["."])
        self.diagnostics: list[Diagnostic] = []
        m = re.search(r"PROGRAM-ID\s*\.\s*([\w-]+)", self.text, re.IGNORECASE)
        self.name = m[1].upper() if m else "PROGRAM"
        head, _, body = re.split(r"\bPROCEDURE(\s+)DIVISION\b", self.text, maxsplit=1, flags=re.IGNORECASE) if re.search(r"\bPROCEDURE\s+DIVISION\b", self.text, re.IGNORECASE) else (self.text, "", "")
        self.files: dict[str, File] = {}
        for m in re.finditer(r"\bSELECT\s+([\w-]+)\s+ASSIGN\s+(?:TO\s+)?('[^']*'|\"[^\"]*\"|[\w.-]*[\w])(.*?)\.(?=\s)", head, re.IGNORECASE | re.DOTALL):
            org = re.search(r"ORGANIZATION\s+(?:IS\s+)?(LINE\s+SEQUENTIAL|INDEXED|RELATIVE)", m[3], re.IGNORECASE)
            key = re.search(r"RECORD\s+KEY\s+(?:IS\s+)?([\w-]+)", m[3], re.IGNORECASE)
            state = re.search(r"STATUS\s+(?:IS\s+)?([\w-]+)", m[3], re.IGNORECASE)
            name = m[1].upper().replace("-", "_")
            self.files[name] = File(name, m[2].strip("'\""), re.sub(r"\s+", " ", org[1].upper()) if org else "SEQUENTIAL", key[1].upper().replace("-", "_") if key else None, status=state[1].upper().replace("-", "_") if state else "")
        own = re.search(r"\bSPECIAL-NAMES\s*\.(.*?)(?=\b(?:INPUT-OUTPUT\s+SECTION|FILE-CONTROL|DATA\s+DIVISION)\b|$)", head, re.IGNORECASE | re.DOTALL)
        sign = re.search(r"CURRENCY\s+(?:SIGN\s+)?(?:IS\s+)?['\"](.)['\"]", own[1] if own else "", re.IGNORECASE)
        self.style = (sign[1] if sign else "$", bool(own and re.search(r"DECIMAL-POINT\s+(?:IS\s+)?COMMA", own[1], re.IGNORECASE)))
        if self.style[1]:  # numbers have commas for points
            body = re.sub(r"(?<=\d),(?=\d)", ".", body)
            head = re.sub(r"(\bVALUE\s+(?:IS\s+)?[+-]?\d*),(?=\d)", r"\1.", head, flags=re.IGNORECASE)
        parts = _sections(re.split(r"\bDATA\s+DIVISION\s*\.", head, flags=re.IGNORECASE)[-1], r"FILE\s+SECTION", r"WORKING-STORAGE\s+SECTION", r"LOCAL-STORAGE\s+SECTION", r"LINKAGE\s+SECTION")
        self.fields: dict[str, Field] = {}
        self.parents: dict[str, list[Field]] = {}
        #: By declared name: the name here (another one if it was declared before), and the groups, record and file around it.
        self.named: dict[str, list[tuple[str, list[str]]]] = {}
        self.declared: dict[str, str] = {}
        for m in re.finditer(r"\b(?:FD|SD)\s+([\w-]+)(.*?)(?=\bFD\s|\bSD\s|$)", parts.get("FILE SECTION", ""), re.IGNORECASE | re.DOTALL):
            f = self.files.setdefault(m[1].upper().replace("-", "_"), File(m[1].upper().replace("-", "_"), m[1]))
            body_at = re.search(r"\b01\s", m[2])
            for top in self._declared(m[2][body_at.start() :] if body_at else "", [f.name]):
                if not f.record:
                    f.record, f.layout = top.name, Layout.of(top.name, *(top.children or (top,)))
            f.key = self._of_file(f, f.key) if f.key else None
        for name in ("WORKING-STORAGE SECTION", "LOCAL-STORAGE SECTION", "LINKAGE SECTION"):
            self._declared(parts.get(name, ""))
        self.using, self.paragraphs, errors = paragraphs(source.words(body.lstrip().removeprefix(".") if body else ""))
        self.diagnostics += [Diagnostic("ERROR", e) for e in errors]
        self.records = {f.record: f for f in self.files.values()}
        self.names88 = {n: f for f in self.fields.values() for n, _ in f.conditions}
        self.paragraphs = self._settled(self.paragraphs)
        for at in sorted(self._names(list(self.paragraphs.values()))):
            if at not in self.fields and at not in self.names88 and at not in REGISTERS and at not in self.files:
                self.diagnostics.append(Diagnostic("ERROR", at.rstrip("@").replace("@", " OF ") + (" is declared more than once" if at.endswith("@") else " isn't declared")))
        self._noted(list(self.paragraphs.values()))
        self.display: list[str | DataFrame] = []

    # data division
    def _declared(self, text: str, owner: list[str] | None = None) -> list[Field]:
        if not text.strip():
            return []
        unnamed = count(1)
        text = re.sub(r"(\b\d\d\s+)(?=(?:PIC|PICTURE|VALUE|REDEFINES|OCCURS)\b)", lambda m: f"{m[1]}FILLER ", text, flags=re.IGNORECASE)
        text = re.sub(r"\bFILLER\b", lambda _: f"FILLER-{next(unnamed)}-{len(self.fields)}", text, flags=re.IGNORECASE)
        layout = Layout.from_copybook(text)
        tops = layout.fields
        if layout.name != "RECORD":
            tops = (Field(layout.name, children=layout.fields),)

        def own(f: Field, above: list[str]) -> Field:
            """The field under a name that no other field has."""
            held = self.named.setdefault(f.name, [])
            name = f"{f.name}__{len(held)}" if held else f.name
            held.append((name, above))
            self.declared[name] = f.name
            pic = f.pic
            if pic and pic.category == "edited" and self.style[1]:
                pic = picture(pic.text.translate(str.maketrans(".,", ",.")))
            children = tuple(own(c, [*above, f.name]) for c in f.children)
            return replace(f, name=name, pic=pic, children=children, redefines=self.named[f.redefines][-1][0] if f.redefines else None, style=self.style)

        def down(f: Field, above: list[Field]) -> None:
            self.fields[f.name], self.parents[f.name] = f, above
            for c in f.children:
                down(c, [*above, f])

        tops = tuple(own(t, owner or []) for t in tops)
        for t in tops:
            down(t, [])
        return list(tops)

    def _found(self, name: str) -> list[str]:
        """The fields that a name with qualifiers (A@B: A OF B) may mean."""
        base, *of = name.split("@")

        def within(above: list[str]) -> bool:
            rest = iter(reversed(above))
            return all(any(x == q for x in rest) for q in of)

        return [n for n, above in self.named.get(base, []) if within(above)]

    def _of_file(self, f: File, name: str) -> str:
        """The field of a file's record that a key names."""
        return next((n for n, above in self.named.get(name, []) if f.name in above), name)

    def _settled(self, tree: object) -> object:
        """Statements with each name that means one field in its form here."""
        if isinstance(tree, tuple) and len(tree) == 4 and tree[0] == "ref":
            found = self._found(tree[1])
            base = tree[1].split("@")[0]
            name = found[0] if len(found) == 1 else base if not found and base in self.names88 else tree[1] + "@" * (len(found) > 1)
            return ("ref", name, self._settled(tree[2]), self._settled(tree[3]))
        if isinstance(tree, (list, tuple)):
            return type(tree)(self._settled(x) for x in tree)
        return {k: self._settled(v) for k, v in tree.items()} if isinstance(tree, dict) else tree

    def _noted(self, tree: object) -> None:
        """Diagnostics of statements that go nowhere, or do nothing."""
        if isinstance(tree, tuple) and len(tree) == 3 and tree[0] == "GO":
            self.diagnostics += [Diagnostic("ERROR", f"GO TO {n}: no such paragraph") for n in tree[1] if n not in self.paragraphs]
        elif isinstance(tree, tuple) and len(tree) == 3 and tree[0] == "NOTHING":
            self.diagnostics.append(Diagnostic("WARNING", f"{tree[1]} does nothing" + (": use operators.records.control_break" if tree[1] in ("INITIATE", "GENERATE", "TERMINATE", "SUPPRESS") else "")))
        elif isinstance(tree, (list, tuple)):
            for x in tree:
                self._noted(x)
        elif isinstance(tree, dict):
            self._noted(list(tree.values()))

    def _names(self, tree: object) -> set[str]:
        """Names that statements refer to."""
        if isinstance(tree, tuple) and len(tree) == 4 and tree[0] == "ref":
            return {tree[1]} | self._names(tree[2]) | self._names(tree[3])
        if isinstance(tree, (list, tuple)):
            return set().union(*map(self._names, tree)) if tree else set()
        return self._names(list(tree.values())) if isinstance(tree, dict) else set()

    def occurs(self, name: str) -> int:
        return max([f.occurs for f in [*self.parents[name], self.fields[name]]])

    def leaves(self, f: Field) -> list[Field]:
        return [f] if f.pic else [x for c in f.children if not c.redefines for x in self.leaves(c)]

    # running
    def run(self, spark: SparkSession, paths: dict[str, str] | None = None, tables: dict[str, DataFrame] | None = None, programs: dict[str, Program] | None = None, arguments: list[V] | None = None, inputs: list[str] | None = None, methods: dict[str, Callable[..., Column]] | None = None, hooks: dict[str, dict[str, Callable[[File], None]]] | None = None) -> Program:
        """Runs the program: paths by ASSIGN name, files that are DataFrames by file name, programs for CALL.

        inputs: lines for ACCEPT; methods: functions of Columns for INVOKE, by name; hooks: by file name, what is called on "open" and "close".
        """
        self._begin(spark, paths, tables, programs, inputs, methods, hooks)
        for name, v in zip(self.using, arguments or []):
            self.assign(("ref", name, [], None), v)
        try:
            self.through(list(self.paragraphs))
        except Stop:
            pass
        for f in self.files.values():
            self._flush(f)
        return self

    def _begin(self, spark: SparkSession, paths: dict | None, tables: dict | None, programs: dict | None, inputs: list[str] | None = None, methods: dict | None = None, hooks: dict | None = None) -> None:
        """All fields and files as at the start of a run."""
        bad = [d.text for d in self.diagnostics if d.level == "ERROR"]
        if bad:
            raise UnsupportedVerbError("; ".join(bad))
        self.spark, self.paths, self.programs, self.tables = spark, paths or {}, programs or {}, {k.upper().replace("-", "_"): v for k, v in (tables or {}).items()}
        self.session, self.env, self.loop, self.display = Session(spark), {}, None, []
        self.inputs, self.methods = iter(inputs or ()), {k.upper(): v for k, v in (methods or {}).items()}
        self.hooks = {k.upper().replace("-", "_"): v for k, v in (hooks or {}).items()}
        for n in REGISTERS:
            self.env[n] = V(Decimal(0), True)
        for f in self.files.values():
            f.mode, f.data, f.rows, f.reads, f.chunks, f.at, f.changes, f.dirty, f.numbered = "", None, None, 0, [], None, {}, False, False
        for f in self.fields.values():
            if f.pic and not self._redefined(f.name):
                start = values.filled("ZEROS" if f.pic.numeric else "SPACES", f)
                if f.value is not None:
                    up = f.value.upper()
                    start = values.filled(up, f) if up in moves.FIGURATIVE else values.moved(V(f.value), f) if f.pic.category != "edited" else V(f.value.ljust(f.pic.size), False, f)
                self.env[f.name] = [start] * n if (n := self.occurs(f.name)) > 1 else start

    def through(self, names: list[str]) -> None:
        """Paragraphs in their order; GO TO one of them goes on from there, to another one leaves."""
        i = 0
        while i < len(names):
            try:
                self.paragraph(names[i])
                i += 1
            except Jump as j:
                if j.name not in names:
                    raise
                i = names.index(j.name)

    def paragraph(self, name: str) -> None:
        try:
            self.block(self.paragraphs[name])
        except Leave:
            pass

    def thru(self, first: str, last: str) -> list:
        order = list(self.paragraphs)
        if first not in order or last not in order:
            raise UnsupportedVerbError(f"no paragraph {first if first not in order else last}")
        return order[order.index(first) : order.index(last) + 1]

    def _redefined(self, name: str) -> Field | None:
        return next((f for f in [*self.parents[name], self.fields[name]] if f.redefines), None)

    # reading and setting fields
    def known(self, v: V) -> V:
        """A value on the driver: expressions of known values only are computed by a plan of one row."""
        if v.known:
            return v
        if self.loop is not None:
            raise Ordered
        return V(self.spark.range(1).select(v.value).first()[0], v.number, v.field)

    def get(self, ref: tuple) -> V:
        _, name, subs, part = ref
        if name in self.names88:
            return self._level88(name)
        f = self.fields.get(name)
        if f is None:
            return self._one(name)
        if over := self._redefined(name):
            whole = self.get(("ref", over.redefines, [], None))
            out = V(values.text(whole).value[f.offset - over.offset :][: f.item_size]) if whole.known else V(F.substring(column(values.text(whole)), f.offset - over.offset + 1, f.item_size))
            out = values.moved(V(out.value), f) if f.pic else out
        elif f.pic is None:
            parts = [self._padded(self.get(("ref", c.name, subs, None)), c) for c in f.children if not c.redefines]
            out = V("".join(p.value for p in parts)) if all(p.known for p in parts) else V(F.concat(*(column(p) for p in parts)))
        else:
            out = self._one(name)
            if isinstance(out, list):
                if not subs:
                    whole = [values.text(x) for x in out]
                    return V("".join(x.value for x in whole)) if all(x.known for x in whole) else V(F.concat(*map(column, whole)))
                i = values.number(self.value(subs[0]))
                if not i.known:
                    return V(moves.element(F.array(*map(column, out)), i.value.cast("int")), out[0].number, f)
                if not 1 <= i.value <= len(out):
                    raise IndexError(f"{name}({i.value}) is beyond the table")
                out = out[int(i.value) - 1]
        if part:
            t, start = values.text(out), values.number(self.value(part[0]))
            size = values.number(self.value(part[1])) if part[1] else None
            if t.known and start.known and (size is None or size.known):
                at = int(start.value) - 1
                return V(t.value[at : None if size is None else at + int(size.value)])
            length = F.length(column(t)) if size is None else column(size).cast("int")
            return V(strings.part(column(t), column(start).cast("int"), length))
        return out

    def _one(self, name: str) -> V | list:
        v = self.env.get(name)
        if callable(v):  # what a loop left, known once it is asked for
            v = self.env[name] = v()
        if v is None:
            raise Unset(name)
        if isinstance(v, Sum):
            raise Ordered
        return v

    def _padded(self, v: V, f: Field) -> V:
        return values.text(v) if f.pic is None or f.pic.numeric else V(v.value, False, f)

    def put(self, name: str, v: V, i: int | None = None) -> None:
        if self.loop is None:
            v = self.known(v)
        if isinstance(self.env.get(name), list):
            if i is None:
                self.env[name] = [v] * len(self.env[name])
            elif not 1 <= i <= len(self.env[name]):
                raise IndexError(f"{name}({i}) is beyond the table")
            else:
                self.env[name] = [v if k == i - 1 else x for k, x in enumerate(self.env[name])]
        else:
            self.env[name] = v

    def assign(self, ref: tuple, v: V, constant: str = "") -> None:
        """MOVE to a field, a group (as text), a part or an element."""
        _, name, subs, part = ref
        f = self.fields.get(name)
        if f is None:
            self.env[name] = values.number(v)
            return
        if part:
            old, start = values.text(self.get(("ref", name, subs, None))), self.known(values.number(self.value(part[0])))
            size = int(self.known(values.number(self.value(part[1]))).value) if part[1] else f.item_size - int(start.value) + 1
            t, at = values.text(v), int(start.value)
            v = V(old.value[: at - 1] + t.value[:size].ljust(size) + old.value[at - 1 + size :]) if old.known and t.known else V(strings.overlaid(column(old), column(t), at, size))
            constant = ""
        if over := self._redefined(name):
            whole = values.text(self.get(("ref", over.redefines, [], None)))
            at, new = f.offset - over.offset, values.text(values.moved(v, f) if f.pic else v)
            n = f.item_size
            self.assign(("ref", over.redefines, [], None), V(whole.value[:at] + new.value[:n].ljust(n) + whole.value[at + n :]) if whole.known and new.known else V(strings.overlaid(column(whole), column(new), at + 1, n)))
            return
        if f.pic is None:
            if constant:
                for leaf in self.leaves(f):
                    self.put(leaf.name, values.filled(constant, leaf) if not leaf.pic.numeric or constant.startswith("ZERO") else values.filled("ZEROS", leaf))
                return
            t, at = values.text(v), 0
            for c in f.children:
                if c.redefines:
                    continue
                n = c.size
                piece = V(t.value[at : at + n].ljust(n)) if t.known else V(F.rpad(F.substring(t.value, at + 1, n), n, " "))
                at += n
                if c.pic and c.pic.numeric and c.occurs == 1:
                    cut = values.number(piece)
                    scale = Decimal(10) ** -c.pic.decimals
                    piece = V(cut.value * scale, True) if cut.known else V(cut.value * F.lit(scale), True)
                if c.occurs == 1:
                    self.assign(("ref", c.name, subs, None), piece)
            return
        i = None
        if subs and isinstance(self.env.get(name), list):
            i = int(self.known(values.number(self.value(subs[0]))).value)
        self.put(name, values.filled(constant, f) if constant else values.moved(v, f), i)

    def store(self, ref: tuple, v: V, rounded: bool) -> V:
        """An arithmetic result to a field; returns whether it was a size error."""
        f = self.fields.get(ref[1])
        if f is None:
            self.env[ref[1]] = v
            return V(False)
        unset = self.loop is not None and ref[1] in self.env and self.env[ref[1]] is None
        old = V(F.lit(None), True) if unset else self.get(ref) if f.pic.category != "edited" else V("")
        new, error = values.stored(v, f, old, rounded)
        if unset and not error.known:
            # On a size error the field would keep what another record left: if there is any, the loop isn't a plan.
            self.loop.checks.append(error.value if self.loop.guard is None else self.loop.guard & error.value)
        i = int(self.known(values.number(self.value(ref[2][0]))).value) if ref[2] else None
        self.put(ref[1], new, i)
        return error

    def value(self, e: tuple) -> V:
        kind = e[0]
        if kind == "num":
            return V(e[1], True)
        if kind in ("text", "all"):
            return V(e[1])
        if kind == "const":
            return V(Decimal(0), True) if e[1].startswith("ZERO") else V(moves.FIGURATIVE[e[1]])
        if kind == "ref":
            return self.get(e)
        if kind == "call":
            if e[1] == "LENGTH" and e[2][0][0] == "ref" and e[2][0][3] is None:
                return V(Decimal(self.fields[e[2][0][1]].size), True)
            args = [self.value(a) for a in e[2]]
            name = {"TRIM": "TRIM"}.get(e[1], e[1])
            out = V(intrinsics.call(name, *(column(a) for a in args)), name in NUMERIC)
            out = V(out.value.cast(values.WIDE), True) if out.number else out
            return self.known(out) if all(a.known for a in args) and self.loop is None else out
        if kind == "&":
            a, b = (values.text(self.value(x)) for x in e[1:])
            return V(a.value + b.value) if a.known and b.known else V(F.concat(column(a), column(b)))
        return values.arithmetic(kind, self.value(e[1]), self.value(e[2]))

    def test(self, c: tuple) -> V:
        kind = c[0]
        if kind == "true":
            return V(True)
        if kind in ("and", "or"):
            return (values.both if kind == "and" else values.either)(self.test(c[1]), self.test(c[2]))
        if kind == "not":
            return values.negated(self.test(c[1]))
        if kind == "name":
            return self._level88(c[1][1]) if c[1][1] in self.names88 else values.compared("<>", self.get(c[1]), V(Decimal(0), True))
        if kind == "class":
            v = self.value(c[2])
            if c[1] in ("POSITIVE", "NEGATIVE", "ZERO"):
                return values.compared({"POSITIVE": ">", "NEGATIVE": "<", "ZERO": "="}[c[1]], v, V(Decimal(0), True))
            t = values.text(v)
            rule = "[0-9.+-]*" if c[1] == "NUMERIC" else "[A-Za-z ]*"
            return V(bool(re.fullmatch(rule, t.value))) if t.known else V((conditions.is_numeric if c[1] == "NUMERIC" else conditions.is_alphabetic)(t.value))
        a, b = self.value(c[1]), self.value(c[2])
        for x, y, e in ((a, b, c[2]), (b, a, c[1])):
            if e[0] == "const" and not x.number and not y.number and x.field:
                whole = V(y.value * x.field.item_size)
                a, b = (a, whole) if e is c[2] else (whole, b)
            elif e[0] == "const" and e[1].startswith("ZERO") and not x.number:
                a, b = (values.number(a), values.number(b))
        return values.compared(kind, a, b)

    def _level88(self, name: str) -> V:
        f = self.names88[name]
        v = self.get(("ref", f.name, [], None))
        if not v.known:
            return V(conditions.level88(f, name, v.value))
        out = V(False)
        for w in dict(f.conditions)[name]:
            low, high = (w if isinstance(w, tuple) else (w, w))
            wrap = lambda s: V(moves.FIGURATIVE[s.upper()] * f.item_size) if s.upper() in moves.FIGURATIVE and not v.number else values.number(V(s)) if v.number else V(s)
            out = values.either(out, values.both(values.compared(">=", v, wrap(low)), values.compared("<=", v, wrap(high))) if low != high else values.compared("=", v, wrap(low)))
        return out

    # statements
    def block(self, statements: list) -> None:
        for k, s in enumerate(statements):
            self.statement(s)

    def branch(self, c: V, yes: list, no: list) -> None:
        """Runs the branch of a known condition; of another, both, and merges what they set."""
        if c.known:
            self.block(yes if c.value else no)
            return
        before, guard = dict(self.env), self.loop.guard
        condition = F.coalesce(c.value, F.lit(False))
        self.loop.guard = condition if guard is None else guard & condition
        self.block(yes)
        after_yes, self.env = self.env, dict(before)
        self.loop.guard = ~condition if guard is None else guard & ~condition
        self.block(no)
        self.loop.guard = guard
        for n in set(after_yes) | set(self.env):
            a, b = after_yes.get(n), self.env.get(n)
            if a is b:
                continue
            if isinstance(a, Sum) and isinstance(b, Sum):
                self.env[n] = Sum(F.when(condition, a.delta).otherwise(b.delta))
            elif isinstance(a, list) and isinstance(b, list):
                self.env[n] = [values.chosen(V(condition), x, y) for x, y in zip(a, b)]
            elif isinstance(a, V) and isinstance(b, V):
                self.env[n] = values.chosen(V(condition), a, b)
            else:
                self.env[n] = None  # set in one branch only: it mustn't be read

    def errors(self, error: V, clauses: dict) -> None:
        if clauses:
            self.branch(error, clauses.get("yes", []), clauses.get("not", []))

    def statement(self, s: tuple) -> None:
        verb = s[0]
        handler = getattr(self, "do_" + verb.lower().replace(" ", "_"), None)
        if handler is None:
            raise UnsupportedVerbError(f"{verb} isn't supported")
        handler(*s[1:])

    def do_block(self, body: list) -> None:
        self.block(body)

    def do_continue(self) -> None:
        pass

    def do_stop(self) -> None:
        if self.loop is not None:
            raise Ordered
        raise Stop

    def do_exit(self) -> None:
        if self.loop is not None:
            raise Ordered
        raise Leave

    def do_go(self, names: list, on: tuple | None) -> None:
        if self.loop is not None:
            raise Ordered
        k = int(self.known(values.number(self.get(on))).value) if on else 1
        if 1 <= k <= len(names):
            raise Jump(names[k - 1])

    def do_exit_perform(self) -> None:
        raise LeaveLoop if self.loop is None else Ordered

    def do_cycle(self) -> None:
        raise Cycle if self.loop is None else Ordered

    def do_nothing(self, verb: str, names: list) -> None:
        pass

    def do_invoke(self, what: tuple, method: tuple, args: list, into: tuple | None) -> None:
        """INVOKE: a method is a function of Columns, by its name or by object and name."""
        name = method[1] if method[0] == "text" else self.known(self.value(method)).value
        own = f"{what[1]}.{name}".upper()
        f = self.methods.get(own) or self.methods.get(name.upper())
        if f is None:
            raise UnsupportedVerbError(f"no method {name}")
        out = V(f(*(column(self.value(a)) for a in args)))
        if into:
            number = self.fields[into[1]].pic.numeric
            self.assign(into, V(out.value.cast(values.WIDE), True) if number else V(out.value.cast("string")))

    def do_move(self, a: tuple, to: list) -> None:
        v = self.value(a)
        for r in to:
            f = self.fields.get(r[1])
            self.assign(r, V(a[1] * -(-f.item_size // len(a[1]))) if a[0] == "all" and f else v, a[1] if a[0] == "const" and f else "")

    def _alike(self, a: Field, b: Field) -> Iterator[tuple[Field, Field]]:
        """Fields of two groups with one declared name, of which at least one is elementary; of groups, their fields."""
        own = {self.declared[c.name]: c for c in a.children if c.occurs == 1 and not c.redefines and not c.name.startswith("FILLER_")}
        for c in b.children:
            o = own.get(self.declared[c.name])
            if o is None or c.occurs > 1 or c.redefines:
                continue
            if o.pic is None and c.pic is None:
                yield from self._alike(o, c)
            else:
                yield o, c

    def do_move_corresponding(self, a: tuple, b: tuple) -> None:
        for x, y in list(self._alike(self.fields[a[1]], self.fields[b[1]])):
            self.assign(("ref", y.name, [], None), self.get(("ref", x.name, [], None)))

    def _total(self, e: list) -> V:
        out = values.number(self.value(e[0]))
        for x in e[1:]:
            out = values.arithmetic("+", out, self.value(x))
        return out

    def _arithmetic(self, sign: str, operands: list, into: list, giving: list | None, clauses: dict) -> None:
        error = V(False)
        if giving is not None:
            # SUBTRACT a b FROM c GIVING d: the last operand is what is subtracted from.
            v = self._total(operands) if sign == "+" else values.arithmetic("-", self.value(operands[0]), self._total(operands[1:]))
            for r, rounded in giving:
                error = values.either(error, self.store(r, v, rounded))
        else:
            v = self._total(operands)
            for r, rounded in into:
                old = self.env.get(r[1])
                if isinstance(old, Sum):
                    p = self.fields[r[1]].pic
                    x = column(v)
                    x = F.round(x, p.decimals) if rounded else numeric.truncated(x, p.decimals)
                    self.env[r[1]] = Sum(old.delta + x if sign == "+" else old.delta - x)
                    if clauses:
                        raise Ordered
                    continue
                error = values.either(error, self.store(r, values.arithmetic(sign, self.get(r), v), rounded))
        self.errors(error, clauses)

    def do_add(self, *a) -> None:
        self._arithmetic("+", *a)

    def do_subtract(self, *a) -> None:
        self._arithmetic("-", *a)

    def _corresponding(self, sign: str, a: tuple, b: tuple, rounded: bool, clauses: dict) -> None:
        error = V(False)
        for x, y in list(self._alike(self.fields[a[1]], self.fields[b[1]])):
            if x.pic and x.pic.numeric and y.pic and y.pic.numeric:
                to = ("ref", y.name, [], None)
                error = values.either(error, self.store(to, values.arithmetic(sign, self.get(to), self.get(("ref", x.name, [], None))), rounded))
        self.errors(error, clauses)

    def do_add_corresponding(self, *a) -> None:
        self._corresponding("+", *a)

    def do_subtract_corresponding(self, *a) -> None:
        self._corresponding("-", *a)

    def do_scale(self, op: str, a: tuple, into: list, clauses: dict) -> None:
        error, v = V(False), self.value(a)
        for r, rounded in into:
            error = values.either(error, self.store(r, values.arithmetic(op, self.get(r), v), rounded))
        self.errors(error, clauses)

    def do_compute(self, into: list, e: tuple, clauses: dict) -> None:
        error, v = V(False), values.number(self.value(e))
        for r, rounded in into:
            error = values.either(error, self.store(r, v, rounded))
        self.errors(error, clauses)

    def do_divide(self, a: tuple, b: tuple, into: list, rest: tuple | None, clauses: dict) -> None:
        x, y, error = values.number(self.value(a)), values.number(self.value(b)), V(False)
        q = values.arithmetic("/", x, y)
        for r, rounded in into:
            error = values.either(error, self.store(r, q, rounded))
        if rest:
            d = self.fields[into[0][0][1]].pic.decimals
            if q.known:
                cut = V(None if q.value is None else values.moved(q, Field("Q", values_picture(d))).value, True)
            else:
                cut = V(numeric.truncated(q.value, d), True)
            error = values.either(error, self.store(rest, values.arithmetic("-", x, values.arithmetic("*", cut, y)), False))
        self.errors(error, clauses)

    def do_if(self, c: tuple, yes: list, no: list) -> None:
        if self.loop is not None and (hit := self.loop.extremum(c, yes, no)) is not None:
            name, x = hit
            self.loop.extremes.setdefault(name, []).append((c, column(self.value(x)), self.loop.guard))
            return
        self.branch(self.test(c), yes, no)

    def do_perform(self, target: tuple | None, body: list | None, spec: tuple | None, after: bool) -> None:
        if spec and spec[0] == "UNTIL" and self.loop is None and self._lowered(target, body, spec[1], after):
            return

        def once() -> None:
            if body is None:
                self.through(self.thru(*target))
                return
            try:
                self.block(body)
            except Cycle:
                pass

        try:
            if spec is None:
                once()
            elif spec[0] == "TIMES":
                for _ in range(int(self.known(values.number(self.value(spec[1]))).value)):
                    once()
            elif spec[0] == "UNTIL":
                self._repeat(spec[1], once, after)
            else:
                self._vary(spec[1], once, after)
        except LeaveLoop:
            if body is None:
                raise

    def _repeat(self, until: tuple, once, after: bool, step=lambda: None) -> None:
        if after:
            once()
            if self._stops(until):
                return
            step()
        while not self._stops(until):
            once()
            if after and self._stops(until):
                return
            step()

    def _stops(self, c: tuple) -> bool:
        v = self.test(c)
        if not v.known:
            if self.loop is not None:
                raise Ordered
            return bool(self.known(v).value)
        return bool(v.value)

    def _vary(self, loops: list, once, after: bool) -> None:
        (v, a, b, until), rest = loops[0], loops[1:]
        self.assign(v, self.value(a))
        self._repeat(until, (lambda: self._vary(rest, once, after)) if rest else once, after, lambda: self.store(v, values.arithmetic("+", self.get(v), self.value(b)), False))

    def do_display(self, operands: list) -> None:
        parts = [values.shown(self.value(e)) for e in operands]
        if self.loop is not None:
            self.loop.emit(("display", None), F.concat(*(column(p) for p in parts)))
        else:
            self.display.append("".join(self.known(p).value for p in parts))

    def do_accept(self, r: tuple, what: str) -> None:
        if not what:
            if self.loop is not None:
                raise Ordered
            self.assign(r, V(next(self.inputs, "")))
            return
        self.assign(r, V(moves.accept(what)) if self.loop is not None else self.known(V(moves.accept(what))))

    def do_set_true(self, names: list) -> None:
        for r in names:
            f = self.names88[r[1]]
            v = dict(f.conditions)[r[1]][0]
            self.assign(("ref", f.name, [], None), V(v[0] if isinstance(v, tuple) else v))

    def do_initialize(self, refs: list) -> None:
        for r in refs:
            for leaf in self.leaves(self.fields[r[1]]):
                if not leaf.name.startswith("FILLER_"):
                    self.put(leaf.name, values.filled("ZEROS" if leaf.pic.numeric else "SPACES", leaf))

    def do_string(self, senders: list, into: tuple, pointer: tuple | None, clauses: dict) -> None:
        def cut(d: tuple | None) -> str | None:
            return None if d is None else self.known(self.value(d)).value

        got = [(column(values.text(self.value(x))), cut(d)) for x, d in senders]
        start = column(values.number(self.get(pointer))).cast("int") if pointer else 1
        out, at, over = strings.string(column(self.get(into)), self.fields[into[1]].item_size, *got, pointer=start)
        self.assign(into, V(out))
        if pointer:
            self.assign(pointer, V(at.cast("decimal(9,0)"), True))
        self.errors(V(over) if self.loop is not None else self.known(V(over)), clauses)

    def do_unstring(self, x: tuple, delimiters: list, every: bool, into: list, tally: tuple | None, pointer: tuple | None, clauses: dict) -> None:
        marks = [self.known(self.value(d)).value for d in delimiters]
        start = column(values.number(self.get(pointer))).cast("int") if pointer else 1
        got, found, after, over = strings.unstring_from(column(values.text(self.get(x))), len(into), *marks, all_=every, pointer=start)
        taken = F.array_size(F.filter(got, lambda v: v.isNotNull()))
        for k, (r, d, n) in enumerate(into):
            v = F.get(got, F.lit(k))
            self.assign(r, V(F.coalesce(v, column(values.text(self.get(r))))))
            if d:
                self.assign(d, V(F.coalesce(F.get(found, F.lit(k)), F.lit(""))))
            if n:
                self.assign(n, V(F.coalesce(F.length(v), column(values.number(self.get(n)))).cast("decimal(9,0)"), True))
        if tally:
            self.store(tally, values.arithmetic("+", self.get(tally), V(taken.cast("decimal(9,0)"), True)), False)
        if pointer:
            self.assign(pointer, V(after.cast("decimal(9,0)"), True))
        self.errors(V(over) if self.loop is not None else self.known(V(over)), clauses)

    def do_inspect(self, x: tuple, rules: list) -> None:
        const = lambda e: None if e is None else self.known(self.value(e)).value
        t = column(values.text(self.get(x)))
        for rule in sorted(rules, key=lambda r: r[0] != "CONVERTING"):
            scope = {k: const(e) for k, e in rule[-1].items()}
            if rule[0] == "TALLYING":
                n = strings.tally(t, rule[1], const(rule[2]) or "", **scope)
                self.store(rule[4], values.arithmetic("+", self.get(rule[4]), V(n.cast("decimal(9,0)"), True)), False)
            elif rule[0] == "REPLACING":
                t = strings.replaced(t, rule[1], const(rule[2]) or "", const(rule[3]), **scope)
            else:
                t = strings.converted(t, const(rule[1]), const(rule[2]), **scope)
        if any(r[0] != "TALLYING" for r in rules):
            self.assign(x, V(t))

    def do_search(self, table: str, every: bool, start: tuple | None, end: list, branches: list) -> None:
        """Linear and ALL alike: the first index that fits; the index is the only field the conditions subscript by."""
        index = start or next((("ref", n, [], None) for n in sorted(set().union(*(self._subscripts(c) for c, _ in branches)))), None)
        if index is None:
            raise UnsupportedVerbError("SEARCH without an index in its conditions")
        first = 1 if every else int(self.known(self.get(index)).value)
        for i in range(max(first, 1), self.occurs(table) + 1):
            self.env[index[1]] = V(Decimal(i), True, self.fields.get(index[1]))
            for c, body in branches:
                v = self.test(c)
                if not v.known:
                    raise Ordered
                if v.value:
                    self.block(body)
                    return
        self.block(end)

    def _subscripts(self, tree: object) -> set[str]:
        if isinstance(tree, tuple) and len(tree) == 4 and tree[0] == "ref":
            return self._names(tree[2])
        return set().union(*map(self._subscripts, tree)) if isinstance(tree, (list, tuple)) and tree else set()

    def do_call(self, program: tuple, args: list, clauses: dict) -> None:
        v = self.value(program)
        if not v.known and self.loop is not None:
            raise Ordered
        name = self.known(v).value.strip().upper()
        callee = self.programs.get(name)
        if callee is None:
            if "yes" not in clauses:
                raise UnsupportedVerbError(f"no program {name}")
            self.block(clauses["yes"])
            return
        if self.loop is None:
            callee.run(self.spark, self.paths, self.tables, self.programs, [self.known(self.value(e)) for _, e in args])
            self.display += callee.display
        else:
            # A field that isn't set yet in this pass is unset for the callee, too.
            unset = {own: e[1] for (_, e), own in zip(args, callee.using) if e[0] == "ref" and e[1] in self.env and self.env[e[1]] is None}
            try:
                callee.within(self, {own: None if own in unset else self.value(e) for (_, e), own in zip(args, callee.using)})
                given = [callee.get(("ref", own, [], None)) if how == "REFERENCE" and e[0] == "ref" else None for (how, e), own in zip(args, callee.using)]
            except Unset as x:
                raise Unset(unset.get(x.name, x.name)) from None
        for k, ((how, e), own) in enumerate(zip(args, callee.using)):
            if how == "REFERENCE" and e[0] == "ref":
                self.assign(e, callee.get(("ref", own, [], None)) if self.loop is None else given[k])
        self.block(clauses.get("not", []))

    def within(self, caller: Program, arguments: dict[str, V | None]) -> None:
        """This program for each record of a caller's loop, as expressions: if all that it does is to compute, from its arguments only."""
        order = [s for p in self.paragraphs.values() for s in p] if len([p for p in self.paragraphs.values() if p]) == 1 else None
        if order is None:  # paragraphs behind the first that ends the program are reached by PERFORM only
            first = next(p for p in self.paragraphs.values() if p)
            order = first if first and first[-1][0] == "STOP" else None
        if order is None:
            raise Ordered
        self._begin(caller.spark, caller.paths, caller.tables, caller.programs, methods=caller.methods)
        self.loop = Called(caller.loop)
        try:
            for name, v in arguments.items():
                if v is None:
                    self.env[name] = None
                else:
                    self.assign(("ref", name, [], None), v)
            self.block(order[:-1] if order and order[-1][0] == "STOP" else order)
        finally:
            self.loop = None

    # files
    def do_open(self, opened: list) -> None:
        for mode, name in opened:
            f = self.files[name]
            if f.mode:
                self._failed(f, "41", {})
                continue
            f.mode, f.rows, f.reads, f.chunks, f.at, f.changes, f.dirty, f.last = mode, None, 0, [], None, {}, mode == "OUTPUT", None
            code = "00"
            if mode in ("INPUT", "I-O") or mode == "EXTEND" and f.key:
                code = "00" if f.name in self.tables else files.status(self.paths.get(f.assign, f.assign), self.spark)
                code = "00" if code == "35" and mode == "EXTEND" else code
                if code != "00" and not f.status:
                    raise FileNotFoundError(f"{f.name}: status {code}")
                there = f.name in self.tables or files.status(self.paths.get(f.assign, f.assign), self.spark) == "00"
                f.data = self._source(f) if code == "00" and there else self.spark.createDataFrame([], f.layout.struct())
                f.mode = mode if code == "00" else ""
            elif f.key:
                f.data = self.spark.createDataFrame([], f.layout.struct())
            self._status(f, code)
            if code == "00" and "open" in self.hooks.get(f.name, {}):
                self.hooks[f.name]["open"](f)

    def _failed(self, f: File, code: str, clauses: dict) -> None:
        """A statement that a file's state doesn't allow, or whose key isn't right: its status, and the block for it."""
        if not f.status and "yes" not in clauses:
            raise OSError(f"{f.show()}: status {code}")
        self._status(f, code)
        self.block(clauses.get("yes", []))

    def _current(self, f: File) -> DataFrame:
        """A file's records with what statements on the driver changed; their number is that of the statements that ran."""
        if not f.changes:
            return f.data
        by, schema = f.key or "rrn", f.layout.struct()
        names, kind = schema.names, schema[f.key].dataType.simpleString() if f.key else "bigint"
        gone = self.spark.createDataFrame([(k,) for k in f.changes], f"{by} {kind}")
        out = f.data.join(gone, by, "left_anti")
        rows = [(k, *r) for k, r in f.changes.items() if r is not None]
        if f.key:
            new = self.spark.createDataFrame([r[1:] for r in rows], schema)
            return out.select(names).unionByName(new).orderBy(f.key)
        new = self.spark.createDataFrame(rows, T.StructType([T.StructField("rrn", T.LongType()), *schema]))
        return out.select("rrn", *names).unionByName(new).orderBy("rrn")

    def _view(self, f: File) -> DataFrame:
        """The records that READ NEXT gives."""
        return f.at if f.at is not None else self._current(f) if f.data is not None else self._source(f)

    def _source(self, f: File) -> DataFrame:
        if f.name in self.tables:
            own = {c.upper(): c for c in self.tables[f.name].columns}
            given = lambda x: own.get(x.name) or own.get(self.declared.get(x.name, x.name))
            df = self.tables[f.name].select(*(F.col(given(x)).cast(x.spark_type()).alias(x.name) if given(x) else moves.initial(x).alias(x.name) for x in f.layout.fields))
            df = df.withColumn("rrn", F.monotonically_increasing_id())
            return df.orderBy(f.key) if f.key and f.organization == "INDEXED" else df
        path = self.paths.get(f.assign, f.assign)
        if f.organization == "LINE SEQUENTIAL":
            return files.read_lines(self.spark, path, f.layout).withColumn("rrn", F.monotonically_increasing_id())
        f.numbered = not f.key
        df = files.read_relative(self.spark, path, f.layout)
        return df.orderBy(f.key) if f.organization == "INDEXED" else df

    def in_sequence(self, df: DataFrame) -> DataFrame:
        """df with rrn, the place of each row in the order of partitions and rows; it is written once, so that the numbers stay."""
        context = self.spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(folders.shared(self.spark))
        part, at = F.spark_partition_id().cast("long"), F.monotonically_increasing_id()
        rows = df.drop("rrn").withColumn("_part", part).withColumn("_at", at - F.shiftleft(part, 33)).checkpoint()
        counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # as many as partitions
        starts, total = [], 0
        for k in sorted(counts):
            starts.append((k, total))
            total += counts[k]
        begun = self.spark.createDataFrame(starts, "_part long, _first long")
        return rows.join(F.broadcast(begun), "_part").withColumn("rrn", F.col("_first") + F.col("_at") + 1).drop("_part", "_at", "_first")

    def do_close(self, names: list) -> None:
        for n in names:
            f = self.files[n]
            was = f.mode
            self._flush(f)
            self._status(f, "00")
            if was and "close" in self.hooks.get(f.name, {}):
                self.hooks[f.name]["close"](f)

    def output(self, f: File) -> DataFrame:
        """What was written to a file, in order; of a keyed file, and of one that was changed in place, all its records."""
        held, columns, frames = [], [x.name for x in f.layout.fields], []
        schema = f.layout.struct()
        for c in [*f.chunks, None]:
            if isinstance(c, tuple):
                held.append(c)
                continue
            if held:
                frames.append(self.spark.createDataFrame(held, schema).coalesce(1))
                held = []
            if c is not None:
                frames.append(c.select(*columns))
        if f.key and f.data is not None:
            out = self._current(f).select(*columns)
            for df in frames:
                out, rejects = records.write_keyed(out, df, f.key)
                if not rejects.isEmpty():
                    self._status(f, "22")
                    self.diagnostics.append(Diagnostic("WARNING", f"records of {f.show()} were left out: their keys were there (status 22)"))
            return out.orderBy(f.key)
        if f.mode == "I-O" and f.data is not None:
            return self._current(f).select(*columns)
        out = None
        for df in frames:
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def _flush(self, f: File) -> None:
        changed = f.chunks or f.dirty or f.changes
        if f.mode in ("OUTPUT", "EXTEND", "I-O") and changed:
            df, path = self.output(f), self.paths.get(f.assign, f.assign)
            if path is None or f.mode == "I-O" and f.name in self.tables:  # kept for output() only
                f.data = df if f.key or f.mode == "I-O" else f.data
                f.chunks = [] if f.key or f.mode == "I-O" else f.chunks
            elif f.organization == "LINE SEQUENTIAL":
                files.write_lines(df, path, f.layout)
            else:
                files.write_fixed(df, path, f.layout, mode="append" if f.mode == "EXTEND" and not f.key else "overwrite")
        f.mode = ""

    def do_read(self, name: str, into: str | None, key: str | None, clauses: dict) -> None:
        f = self.files[name]
        if f.key and (key or f.organization == "INDEXED" and self.loop is not None and self.loop.file is not f):
            self._keyed(f, into, clauses)
            return
        if self.loop is not None:
            if self.loop.file is not f or self.loop.seen:
                raise Ordered
            self.loop.seen = True
            self.loop.enter(f, into)
            self.block(clauses.get("not", []))
            return
        if f.mode in ("OUTPUT", "EXTEND"):
            self._failed(f, "37", clauses)
            return
        f.reads += 1
        if f.rows is None:
            f.rows = self._view(f).toLocalIterator(prefetchPartitions=True)
        row = next(f.rows, None)
        f.last = row["rrn"] if row is not None and "rrn" in row else None
        self._status(f, "10" if row is None else "00")
        if row is None:
            self.block(clauses.get("yes", []))
            return
        for x in f.layout.fields:
            self._row(x, row[x.name])
        if into:
            self.assign(("ref", into, [], None), self.get(("ref", f.record, [], None)))
        self.block(clauses.get("not", []))

    def _row(self, f: Field, value: object) -> None:
        if f.pic is None:
            for c in f.children:
                if not c.redefines:
                    self._row(c, None if value is None else value[c.name])
        elif isinstance(value, list):
            self.env[f.name] = [V(x, f.pic.numeric, f) for x in value]
        elif not f.redefines:
            self.env[f.name] = V(value, f.pic.numeric, f) if value is not None else values.filled("ZEROS" if f.pic.numeric else "SPACES", f)

    def _keyed(self, f: File, into: str | None, clauses: dict) -> None:
        key = self.get(("ref", f.key, [], None))
        if self.loop is None:
            if key.value in f.changes:
                held = f.changes[key.value]
                row = None if held is None else dict(zip(f.layout.struct().names, held))
            else:
                row = (f.data if f.data is not None else self._source(f)).where(F.col(f.key) == F.lit(key.value)).first()
            if row is not None:
                for x in f.layout.fields:
                    self._row(x, row[x.name])
            self._status(f, "23" if row is None else "00")
        else:
            data = self._current(f) if f.data is not None else self._source(f)
            n = len(self.loop.joins)
            mine = [x for x in f.layout.fields if x.pic and x.occurs == 1]
            found = data.select(F.struct(*(x.name for x in mine)).alias(f"_hit{n}"), F.col(f.key).alias(f"_key{n}"))
            self.loop.joins.append((found, key.value == F.col(f"_key{n}")))
            hit = F.col(f"_hit{n}").isNotNull()
            for x in mine:
                self.env[x.name] = values.chosen(V(hit), V(F.col(f"_hit{n}.{x.name}"), x.pic.numeric, x), self.env[x.name] if isinstance(self.env.get(x.name), V) else V(F.lit(None)))
            self.branch(V(hit), clauses.get("not", []), clauses.get("yes", []))
            return
        if row is not None and into:
            self.assign(("ref", into, [], None), self.get(("ref", f.record, [], None)))
        self.block(clauses.get("yes" if row is None else "not", []))

    def do_write(self, record: str, source_: tuple | None, advancing: tuple | None, clauses: dict) -> None:
        f = self.records[record]
        if source_ is not None:
            self.do_move(source_, [("ref", record, [], None)])
        if self.loop is None and f.mode == "INPUT":
            self._failed(f, "37", clauses)
            return
        if f.key and f.data is not None:
            if self.loop is None:
                self._write_key(f, clauses)
                return
            if clauses:
                raise Ordered
        blanks = int(self.known(values.number(self.value(advancing[1]))).value) - 1 if advancing and not isinstance(advancing[1], str) else 0
        empty = [moves.initial(x) for x in f.layout.fields] if blanks > 0 else []
        if self.loop is not None:
            own = [self._image(x) for x in f.layout.fields]
            for r in [own] if blanks <= 0 else [empty] * blanks + [own] if advancing[0] == "AFTER" else [own] + [empty] * blanks:
                self.loop.emit(("file", f.name), F.struct(*(c.cast(x.spark_type()).alias(x.name) for c, x in zip(r, f.layout.fields))))
            return
        one, none = tuple(self._held(x) for x in f.layout.fields), tuple(self._blank(x) for x in f.layout.fields)
        f.chunks += [one] if blanks <= 0 else [none] * blanks + [one] if advancing[0] == "AFTER" else [one] + [none] * blanks
        self._status(f, "00")

    def _image(self, x: Field) -> Column:
        """A field of a record as a column of its type: groups as structs, tables as arrays."""
        if x.occurs > 1:
            if x.pic:
                return F.array(*(column(v) for v in self.env[x.name]))
            return F.array(*(F.struct(*(column(self.get(("ref", c.name, [("num", Decimal(i + 1))], None))).cast(c.spark_type()).alias(c.name) for c in x.children)) for i in range(x.occurs)))
        if x.pic is None:
            return F.struct(*(self._image(c).cast(c.spark_type()).alias(c.name) for c in x.children))
        return column(self.get(("ref", x.name, [], None)))

    def _held(self, x: Field, i: int | None = None) -> object:
        """The same on the driver."""
        if x.occurs > 1 and i is None:
            return [self._held(x, k + 1) for k in range(x.occurs)]
        if x.pic is None:
            return tuple(self._held(c, i) for c in x.children)
        return self.known(self.get(("ref", x.name, [("num", Decimal(i))] if i else [], None))).value

    def _blank(self, x: Field) -> object:
        one = tuple(self._blank(c) for c in x.children) if x.pic is None else values.filled("ZEROS" if x.pic.numeric else "SPACES", x).value
        return [one] * x.occurs if x.occurs > 1 else one

    def _key(self, f: File) -> object:
        return self.known(self.get(("ref", f.key, [], None))).value

    def _there(self, f: File, key: object) -> bool:
        return f.changes[key] is not None if key in f.changes else not f.data.where(F.col(f.key) == F.lit(key)).isEmpty()

    def _write_key(self, f: File, clauses: dict) -> None:
        key = self._key(f)
        if self._there(f, key):
            self._failed(f, "22", clauses)
            return
        f.changes[key] = tuple(self._held(x) for x in f.layout.fields)
        self._status(f, "00")
        self.block(clauses.get("not", []))

    def do_rewrite(self, record: str, source_: tuple | None, _: object, clauses: dict) -> None:
        f = self.records[record]
        if source_ is not None:
            self.do_move(source_, [("ref", record, [], None)])
        if self.loop is not None:
            if self.loop.file is not f or clauses or f.key and self.get(("ref", f.key, [], None)).value is not self.loop.key:
                raise Ordered
            self.loop.rewritten.append((self.loop.guard, {x.name: self._image(x).cast(x.spark_type()) for x in f.layout.fields}))
            return
        if f.mode != "I-O":
            self._failed(f, "37", clauses)
            return
        key = self._key(f) if f.key else f.last
        if key is None or f.key and not self._there(f, key):
            self._failed(f, "23" if f.key else "41", clauses)
            return
        f.changes[key] = tuple(self._held(x) for x in f.layout.fields)
        self._status(f, "00")
        self.block(clauses.get("not", []))

    def do_delete(self, name: str, clauses: dict) -> None:
        f = self.files[name]
        if self.loop is not None:
            if self.loop.file is not f or clauses or not f.key:
                raise Ordered
            self.loop.deleted.append(self.loop.guard)
            return
        if not f.key:
            self._failed(f, "41", clauses)
            return
        key = self._key(f)
        if f.mode != "I-O" or not self._there(f, key):
            self._failed(f, "37" if f.mode != "I-O" else "23", clauses)
            return
        f.changes[key] = None
        self._status(f, "00")
        self.block(clauses.get("not", []))

    def do_start(self, name: str, op: str, key: tuple | None, clauses: dict) -> None:
        f = self.files[name]
        value = self.known(self.get(key or ("ref", f.key, [], None))).value
        relation = {"=": "EQUAL", ">": "GREATER", ">=": "NOT LESS"}.get(op)
        if relation is None or self.loop is not None:
            raise Ordered if self.loop is not None else UnsupportedVerbError(f"START with {op}")
        found = records.start(self._current(f), f.key, relation, value)
        missing = found.isEmpty()
        if missing:
            self._failed(f, "23", clauses)
            return
        f.at, f.rows, f.reads = found, None, 0
        self._status(f, "00")
        self.block(clauses.get("not", []))

    def do_generate(self, form: str, into: tuple, group: str, clauses: dict) -> None:
        """JSON or XML GENERATE: the group's elementary fields, flat; text without its trailing blanks."""
        mine = [x for x in self.leaves(self.fields[group]) if x.occurs == 1 and not x.name.startswith("FILLER_")]
        row = F.struct(*((column(v) if (v := self.get(("ref", x.name, [], None))).number else F.rtrim(column(v))).alias(x.name) for x in mine))
        self.assign(into, V(F.to_json(row) if form == "JSON" else F.to_xml(row, {"rowTag": group})))
        self.block(clauses.get("not", []))

    def do_parse(self, form: str, text: tuple, group: str, clauses: dict) -> None:
        mine = [x for x in self.leaves(self.fields[group]) if x.occurs == 1 and not x.name.startswith("FILLER_")]
        schema = ", ".join(f"`{x.name}` {x.pic.spark_type().simpleString()}" for x in mine)
        t = F.rtrim(column(values.text(self.get(text))))
        row = F.from_json(t, schema) if form == "JSON" else F.from_xml(t, schema, {"rowTag": group})
        for x in mine:
            blank = values.filled("ZEROS" if x.pic.numeric else "SPACES", x)
            self.assign(("ref", x.name, [], None), V(F.coalesce(row[x.name], column(blank)), x.pic.numeric))
        self.block(clauses.get("not", []))

    def _status(self, f: File, code: str) -> None:
        if f.status in self.fields:
            self.assign(("ref", f.status, [], None), V(code))

    def do_sort(self, name: str, keys: list, using: list, giving: list, procedures: dict) -> None:
        f = self.files[name]
        f.chunks = []
        if "INPUT" in procedures:
            for p in self.thru(*procedures["INPUT"]):
                self.paragraph(p)
            df = self.output(f).withColumn("_file", F.lit(0)).withColumn("rrn", F.monotonically_increasing_id())
        else:
            df = None
            for k, u in enumerate(using):
                part = self._source(self.files[u])
                part = part.select(*(F.col(a.name).alias(b.name) for a, b in zip(self.files[u].layout.fields, f.layout.fields)), F.lit(k).alias("_file"), "rrn")
                df = part if df is None else df.unionByName(part)
        df = records.sort(df, *((self._of_file(f, k), how) for k, how in keys), "_file", "rrn").drop("_file", "rrn")
        for g in giving:
            out = self.files[g]
            out.mode, out.chunks = "OUTPUT", [df.select(*(F.col(a.name).alias(b.name) for a, b in zip(f.layout.fields, out.layout.fields)))]
            self._flush(out)
        if "OUTPUT" in procedures:
            f.data, f.rows, f.reads = df.withColumn("rrn", F.monotonically_increasing_id()), None, 0
            for p in self.thru(*procedures["OUTPUT"]):
                self.paragraph(p)

    do_merge = do_sort

    # embedded SQL
    def _host(self) -> dict:
        out = {}
        for n in self.env:
            v = self._one(n) if not isinstance(self.env[n], (list, Sum)) and self.env[n] is not None else None
            if isinstance(v, V) and v.known:
                out[n] = v.value
        return out

    def do_sql(self, text: str) -> None:
        verb = text.split(None, 1)[0].upper()
        if verb in ("COMMIT", "ROLLBACK"):
            getattr(self.session, verb.lower())()
            code = 0
        elif m := re.match(r"DECLARE\s+([\w-]+)\s+CURSOR\s+(?:WITH\s+HOLD\s+)?FOR\s+(.*)", text, re.IGNORECASE | re.DOTALL):
            self.session.declare(m[1].upper(), m[2])
            return
        elif m := re.match(r"OPEN\s+([\w-]+)", text, re.IGNORECASE):
            name = m[1].upper()
            f = self.files["CURSOR " + name] = File("CURSOR " + name, "")
            f.data = self.session.query(self.session.cursors[name], **self._host())
            code = 0
        elif m := re.match(r"FETCH\s+([\w-]+)\s+INTO\s+(.*)", text, re.IGNORECASE | re.DOTALL):
            code = self._fetch(self.files["CURSOR " + m[1].upper()], re.findall(r":([\w-]+)", m[2]))
            if code is None:
                return
        elif verb == "CLOSE":
            code = 0
        elif verb == "SELECT":
            if self.loop is not None:
                raise Ordered
            names = [n.upper().replace("-", "_") for n in re.findall(r":([\w-]+)", re.search(r"\bINTO\b(.*?)\bFROM\b", text, re.IGNORECASE | re.DOTALL)[1])]
            got = self.session.select_into(text, **self._host())
            code = got.code
            for n, x in zip(names, got.value or ()):
                self._from_sql(n, x)
        elif m := re.match(r"DELETE\s+FROM\s+([\w.]+)(?:\s+WHERE\s+(.*))?$", text, re.IGNORECASE | re.DOTALL):
            code = self.session.delete(m[1], self._literal(m[2] or "true")).code
        elif m := re.match(r"UPDATE\s+([\w.]+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?$", text, re.IGNORECASE | re.DOTALL):
            sets = dict(re.split(r"\s*=\s*", p.strip(), maxsplit=1) for p in re.split(r",(?![^(]*\))", m[2]))
            code = self.session.update(m[1], self._literal(m[3] or "true"), **{k: self._literal(e) for k, e in sets.items()}).code
        elif m := re.match(r"INSERT\s+INTO\s+([\w.]+)\s*(?:\(([^)]*)\))?\s*VALUES\s*\((.*)\)$", text, re.IGNORECASE | re.DOTALL):
            names = [c.strip() for c in m[2].split(",")] if m[2] else self.session._table(m[1]).columns
            row = self.spark.sql(f"select {self._literal(m[3])}").toDF(*names)
            missing = [c for c in self.session._table(m[1]).columns if c not in names]
            code = self.session.insert(m[1], row.withColumns({c: F.lit(None) for c in missing}) if missing else row).code
        else:
            raise UnsupportedVerbError(f"EXEC SQL {verb}")
        self.env["SQLCODE"] = V(Decimal(code), True)

    def _literal(self, text: str) -> str:
        """Host variables as SQL literals, quotes doubled."""
        def put(m: re.Match) -> str:
            if m[1]:
                return m[1]
            v = self.known(self.get(("ref", m[2].upper().replace("-", "_"), [], None)))
            return values.plain(v.value) if v.number else "'" + v.value.rstrip().replace("\\", "\\\\").replace("'", "\\'") + "'"

        return re.sub(r"('[^']*')|:([A-Za-z][\w-]*)", put, text)

    def _from_sql(self, name: str, x: object) -> None:
        v = V(Decimal(0), True) if x is None and self.fields[name].pic.numeric else V("") if x is None else V(Decimal(str(x)), True) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else V(str(x))
        self.assign(("ref", name, [], None), v)

    def _fetch(self, f: File, names: list[str]) -> int | None:
        names = [n.upper().replace("-", "_") for n in names]
        if self.loop is not None:
            if self.loop.file is not f or self.loop.seen:
                raise Ordered
            self.loop.seen = True
            types = dict(f.data.dtypes)
            for n, c in zip(names, f.data.columns):
                isnum = not types[c].startswith(("string", "date", "timestamp", "boolean"))
                value = F.coalesce(F.col(c).cast(values.WIDE), F.lit(0)) if isnum else F.coalesce(F.col(c).cast("string"), F.lit(""))
                self.assign(("ref", n, [], None), V(value, isnum))
            self.env["SQLCODE"] = V(Decimal(0), True)
            return None
        f.reads += 1
        if f.rows is None:
            f.rows = f.data.toLocalIterator(prefetchPartitions=True)
        row = next(f.rows, None)
        for n, x in zip(names, row or ()):
            self._from_sql(n, x)
        return 100 if row is None else 0

    # loops
    def _inlined(self, target: tuple | None, body: list | None) -> list:
        """The statements of a body, with those of paragraphs that it performs once in their places."""
        out = body if body is not None else [s for p in self.thru(*target) for s in self.paragraphs[p]]
        flat = []
        for s in out:
            flat += self._inlined(s[1], s[2]) if s[0] == "PERFORM" and s[3] is None else [s]
        return flat

    def _lowered(self, target: tuple | None, body: list | None, until: tuple, after: bool) -> bool:
        """Lowers a reading loop to a plan and runs it; false if it isn't one, or if it depends on order."""
        statements = self._inlined(target, body)
        reads = [(k, f) for k, s in enumerate(statements) if (f := self._reads(s)) is not None and f.rows is None or f is not None and f.reads == 1]
        if len(reads) != 1 or after:
            return False
        k, f = reads[0]
        if not (k == 0 and f.reads == 0 or k == len(statements) - 1 and f.reads == 1) or f.data is None or f.mode in ("OUTPUT", "EXTEND"):
            return False
        saved, files_before, shown_before = dict(self.env), {n: list(x.chunks) for n, x in self.files.items()}, len(self.display)
        statements = [statements[k], *statements[:k], *statements[k + 1 :]]
        carried: set[str] = set()
        while True:
            self.loop = Loop(self, f, statements, carried)
            try:
                self.loop.prepare(statements)
                self.block(statements)
                loop, self.loop = self.loop, None
                after_env, self.env = self.env, dict(saved)
                loop.finish(after_env, saved, until)
                break
            except (Ordered, UnsupportedVerbError, TypeError, AnalysisException) as e:
                written = self.loop.written if self.loop else set()
                self.env, self.loop = dict(saved), None
                for n, chunks in files_before.items():
                    self.files[n].chunks = list(chunks)
                del self.display[shown_before:]
                if isinstance(e, Unset) and e.name in written and e.name not in carried and isinstance(saved.get(e.name), V):
                    carried.add(e.name)  # once more, with what the record before has left
                    continue
                why = str(e).splitlines()[0] if str(e) else ""
                self.diagnostics.append(Diagnostic("WARNING", f"a loop over {f.name} depends on the order of its records and runs on the driver" + (f": {why}" if why else "")))
                return False
        self.diagnostics.append(Diagnostic("INFO", f"a loop over {f.name} is one plan"))
        self._end(statements[0], f)
        return True

    def _reads(self, s: tuple) -> File | None:
        if s[0] == "READ" and not s[3]:
            f = self.files[s[1]]
            return f if f.organization != "INDEXED" or f.mode == "INPUT" else None
        if s[0] == "SQL" and (m := re.match(r"FETCH\s+([\w-]+)", s[1], re.IGNORECASE)):
            return self.files.get("CURSOR " + m[1].upper())
        return None

    def _end(self, read: tuple, f: File) -> None:
        f.rows, f.reads = iter(()), f.reads + 1
        if read[0] == "SQL":
            self.env["SQLCODE"] = V(Decimal(100), True)
        else:
            self._status(f, "10")
            self.block(read[4].get("yes", []))


#: Registers that are there without a declaration.
REGISTERS = ("SQLCODE", "RETURN_CODE", "SORT_RETURN")
NUMERIC = {"ABS", "INTEGER", "INTEGER-PART", "LENGTH", "LOG", "LOG10", "MAX", "MEAN", "MEDIAN", "MIN", "MOD", "NUMVAL", "NUMVAL-C", "ORD", "REM", "SQRT"}


def values_picture(decimals: int):
    from ..picture import picture

    return picture("S9(28)" + (f"V9({decimals})" if decimals else ""))


@dataclass
class Sum:
    """A field that a loop only adds to: what one record adds."""

    delta: Column


class Loop:
    def __init__(self, program: Program, file: File, statements: list, carried: set[str] = frozenset()):
        self.program, self.file, self.guard, self.seen, self.carried, self.written = program, file, None, False, carried, set()
        self.outputs: dict[tuple, list[tuple[Column | None, Column]]] = {}
        self.joins: list[tuple[DataFrame, Column]] = []
        self.extremes: dict[str, list] = {}
        self.checks: list[Column] = []
        self.body, self.key = statements, None
        self.rewritten: list[tuple[Column | None, dict[str, Column]]] = []
        self.deleted: list[Column | None] = []

    def prepare(self, statements: list) -> None:
        """Marks what the body writes: fields that it only adds to become sums, the others must be set before they are read."""
        p = self.program
        added, other = set(), set()

        def walk(tree: object) -> None:
            if isinstance(tree, tuple) and tree and tree[0] in ("ADD", "SUBTRACT") and len(tree) == 5:
                other.update(p._names(tree[1]) | p._names(tree[3] or []))
                for r, _ in tree[2]:
                    added.add(r[1])
                    other.update(p._names(r[2]))
                if tree[3] is not None:
                    other.update(r[1] for r, _ in tree[2])
                walk(tree[4])
            elif isinstance(tree, tuple) and len(tree) > 2 and isinstance(tree[0], str) and tree[0].endswith(" CORRESPONDING"):
                other.update(f.name for both in p._alike(p.fields[tree[1][1]], p.fields[tree[2][1]]) for f in both)
            elif isinstance(tree, tuple) and tree and tree[0] == "PERFORM" and tree[1]:
                for name in p.thru(*tree[1]):
                    walk(p.paragraphs[name])
                other.update(p._names(tree[3]))
            elif isinstance(tree, tuple) and len(tree) == 4 and tree[0] == "ref":
                other.update(p._names(tree))
            elif isinstance(tree, (list, tuple)):
                for x in tree:
                    walk(x)
            elif isinstance(tree, dict):
                walk(list(tree.values()))
            elif isinstance(tree, str) and tree in p.fields:  # records and groups by name
                other.update(x.name for x in p.leaves(p.fields[tree]))

        walk(statements)
        self.written = set()

        def targets(tree: object) -> None:
            if isinstance(tree, tuple) and tree:
                if tree[0] == "MOVE" and len(tree) == 3:
                    self.written.update(x.name for r in tree[2] if r[1] in p.fields for x in p.leaves(p.fields[r[1]]))
                elif tree[0] in ("ADD", "SUBTRACT") and len(tree) == 5:
                    self.written.update(r[1] for r, _ in (tree[3] if tree[3] is not None else tree[2]))
                elif tree[0] in ("COMPUTE", "SCALE", "DIVIDE"):
                    self.written.update(r[0][1] for x in tree[1:] if isinstance(x, list) for r in x if isinstance(r, tuple) and isinstance(r[0], tuple))
                elif tree[0].endswith(" CORRESPONDING") if isinstance(tree[0], str) else False:
                    self.written.update(y.name for _, y in p._alike(p.fields[tree[1][1]], p.fields[tree[2][1]]))
                elif tree[0] == "SET TRUE":
                    self.written.update(p.names88[r[1]].name for r in tree[1])
                elif tree[0] == "PERFORM" and tree[1]:
                    for name in p.thru(*tree[1]):
                        targets(p.paragraphs[name])
                elif tree[0] in ("STRING", "UNSTRING", "INSPECT", "INITIALIZE", "ACCEPT", "CALL", "SEARCH", "INVOKE"):
                    self.written.update(x.name for n in p._names(tree) if n in p.fields for x in p.leaves(p.fields[n]) if tree[0] not in ("CALL", "SEARCH"))
                if tree[0] == "CALL":
                    self.written.update(x.name for how, e in tree[2] if how == "REFERENCE" and e[0] == "ref" and e[1] in p.fields for x in p.leaves(p.fields[e[1]]))
                if tree[0] == "READ" and len(tree) == 5:
                    targets(tree[4].get("not", []))  # what AT END does isn't part of a pass
                    return
            if isinstance(tree, (list, tuple)):
                for x in tree:
                    targets(x)
            elif isinstance(tree, dict):
                targets(list(tree.values()))

        targets(statements)
        self.sums = {n for n in added - other - self.carried if n in p.fields and p.fields[n].pic and p.fields[n].pic.numeric and p.occurs(n) == 1}
        constant = self._same(statements)
        for n in self.written:
            if n in self.sums:
                p.env[n] = Sum(F.lit(0).cast("decimal(38,%d)" % p.fields[n].pic.decimals))
            elif n in self.carried:
                p.env[n] = V(F.col(f"_before_{n}"), p.fields[n].pic.numeric, p.fields[n])
            elif n not in constant and not n.startswith("FILLER_") and n in p.env and not isinstance(p.env[n], list):
                p.env[n] = None
        self.entry = dict(p.env)

    def _same(self, statements: list) -> set[str]:
        """Fields that a maximum or minimum is kept in: their conditions read them, and that is all."""
        out = set()

        def walk(tree: object) -> None:
            if isinstance(tree, tuple) and tree and tree[0] == "IF" and len(tree) == 4 and (hit := self.extremum(*tree[1:])):
                out.add(hit[0])
            elif isinstance(tree, (list, tuple)):
                for x in tree:
                    walk(x)

        walk(statements)
        return out

    def extremum(self, c: tuple, yes: list, no: list) -> tuple[str, tuple] | None:
        """IF x > m MOVE x TO m END-IF: the field m and x."""
        if no or len(yes) != 1 or yes[0][0] != "MOVE" or c[0] not in (">", "<", ">=", "<=") or c[1][0] != "ref" or c[2][0] != "ref":
            return None
        x, m, op = (c[1], c[2], c[0]) if yes[0][1] == c[1] else (c[2], c[1], {">": "<", "<": ">", ">=": "<=", "<=": ">="}[c[0]])
        return (m[1], x) if yes[0][1] == x and yes[0][2] == [m] and m[1] in self.program.env and not m[2] and not m[3] else None

    def enter(self, f: File, into: str | None) -> None:
        p = self.program

        def leaf(x: Field, c: Column) -> None:
            if x.redefines:
                return
            if x.pic is None and x.occurs == 1:
                for child in x.children:
                    leaf(child, c[child.name])
            elif x.occurs > 1:
                if x.pic:
                    p.env[x.name] = [V(F.get(c, F.lit(i)), x.pic.numeric, x) for i in range(x.occurs)]
                else:
                    for child in x.children:
                        p.env[child.name] = [V(F.get(c, F.lit(i))[child.name], child.pic.numeric, child) for i in range(x.occurs)]
            else:
                p.env[x.name] = V(c, x.pic.numeric, x)

        for x in f.layout.fields:
            leaf(x, F.col(x.name))
        self.key = p.env[f.key].value if f.key else None
        if into:
            p.assign(("ref", into, [], None), p.get(("ref", f.record, [], None)))

    def emit(self, to: tuple, row: Column) -> None:
        self.outputs.setdefault(to, []).append((self.guard, row))

    def finish(self, after: dict, saved: dict, until: tuple) -> None:
        p = self.program
        whole = df = p._view(self.file)
        for found, on in self.joins:
            df = df.join(found, on, "left")
        if self.carried:
            df = self._with_before(df, after, saved)
        extremes = {n: rules for n, rules in self.extremes.items()}
        added = {n: after[n].delta for n in self.sums if isinstance(after.get(n), Sum)}
        totals = [F.sum(c).alias(f"s_{n}") for n, c in added.items()]
        totals += [F.count_if(c).alias(f"e_{k}") for k, c in enumerate(self.checks)]
        for n, rules in extremes.items():
            if n in self.written and isinstance(after.get(n), V) and not after[n].known:
                raise Ordered  # set elsewhere in the body, too
            for k, (c, x, guard) in enumerate(rules):
                x = x if guard is None else F.when(guard, x)
                big = self._grows(c, n)
                totals.append((F.max(x) if big else F.min(x)).alias(f"m_{n}_{k}"))
        row = df.agg(*totals).first() if totals else None
        if any(row[f"e_{k}"] for k in range(len(self.checks))):
            raise Ordered
        for n in added:
            f = p.fields[n]
            total = saved[n].value + (row[f"s_{n}"] or 0)
            if abs(total) >= 10**f.pic.whole:
                raise Ordered  # a size error on the way: which record hits it depends on the order
            p.env[n] = values.moved(V(total, True), f)
        for n, rules in extremes.items():
            v = saved[n]
            for k, (c, _, _) in enumerate(rules):
                if (x := row[f"m_{n}_{k}"]) is not None:
                    w = values.moved(V(x, v.number), p.fields[n])
                    if values.compared(">" if self._grows(c, n) else "<", w, v).value:
                        v = w
            p.env[n] = v
        for to, rows in self.outputs.items():
            if len(rows) == 1:
                guard, one = rows[0]
                out = (df if guard is None else df.where(guard)).select(one.alias("r"))
            else:
                made = [F.struct(F.lit(True).alias("on") if g is None else F.coalesce(g, F.lit(False)).alias("on"), r.alias("r")) for g, r in rows]
                out = df.select(F.explode(F.array(*made)).alias("x")).where("x.on").select(F.col("x.r").alias("r"))
            if to[0] == "display":
                p.display.append(out.select(F.col("r").alias("line")))
            else:
                p.files[to[1]].chunks.append(out.select("r.*"))
        if self.rewritten or self.deleted:  # REWRITE and DELETE of the record that was read: one pass over the file
            if self.joins or self.file.at is not None or whole is not self.file.data:
                raise Ordered
            new = {}
            for guard, row in self.rewritten:
                for n, c in row.items():
                    new[n] = c if guard is None else F.when(guard, c).otherwise(new.get(n, F.col(n)))
            gone = F.lit(False)
            for guard in self.deleted:
                gone = gone | (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False)))
            self.file.data, self.file.dirty = df.select(*(new.get(c, F.col(c)).alias(c) for c in whole.columns), gone.alias("_gone")).where("not _gone").drop("_gone"), True
        # What the last record left in other fields is found once it is asked for.
        late = {n: v for n, v in after.items() if n not in added and n not in extremes and isinstance(v, V) and not v.known}
        order = F.col("rrn") if "rrn" in df.columns else F.monotonically_increasing_id()
        for n, v in late.items():
            def last(n: str = n, v: V = v) -> V:
                got = df.select(v.value.alias("v"), order.alias("_at")).orderBy(F.desc("_at")).limit(1).collect()
                return V(got[0]["v"], v.number, v.field) if got else saved[n]

            p.env[n] = last
        for n, v in after.items():
            if isinstance(v, V) and v.known and n not in added and n not in extremes:
                p.env[n] = v if df is whole and n in self.written and not df.isEmpty() or n == "SQLCODE" else saved.get(n, v)

    def _with_before(self, df: DataFrame, after: dict, saved: dict) -> DataFrame:
        """Records with what each carried field held when they were read: an equality join of a record's number with the one before."""
        p, left = self.program, {}
        for n in self.carried:
            v = after.get(n)
            if not isinstance(v, V) or not v.known and "_before_" in str(v.value):
                raise Ordered(f"{n} depends on more than the record before")
            left[n] = column(v).cast(p.fields[n].pic.spark_type())
        rows = df if self.file.numbered and "rrn" in df.columns else p.in_sequence(df)
        before = rows.select((F.col("rrn") + 1).alias("_at"), *(c.alias(f"_left_{n}") for n, c in left.items()))
        rows = rows.join(before, rows["rrn"] == before["_at"], "left")
        first = F.col("_at").isNull()
        return rows.withColumns({f"_before_{n}": F.when(first, column(saved[n]).cast(p.fields[n].pic.spark_type())).otherwise(F.col(f"_left_{n}")) for n in left})

    def _grows(self, c: tuple, m: str) -> bool:
        return c[0] in (">", ">=") if c[2][1] == m else c[0] in ("<", "<=")


class Called:
    """The loop of a caller, as the program sees it that it calls: conditions and checks are the caller's, no file is."""

    def __init__(self, outer: Loop | Called):
        self.outer, self.file, self.seen, self.key, self.joins = outer, None, False, None, []

    @property
    def guard(self) -> Column | None:
        return self.outer.guard

    @guard.setter
    def guard(self, c: Column | None) -> None:
        self.outer.guard = c

    @property
    def checks(self) -> list[Column]:
        return self.outer.checks

    def extremum(self, *_) -> None:
        return None

    def emit(self, *_) -> None:
        raise Ordered


def run(text: str, spark: SparkSession, folders: list[str] | None = None, **options) -> Program:
    return Program(text, folders).run(spark, **options)
