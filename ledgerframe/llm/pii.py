"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors (at-signs, plus signs, digits, schemes and cues of identifiers); a local
parser then expands each anchor to its span and validates it. Parsers never look back over an earlier match of their kind, and
a digit run is tried once, so that the work is linear in the text. Map-only; a document is the unit of work.

Kinds: email, ip, card and phone as base; url (a scheme's address), iban (mod 97), account (a number after an account cue),
ssn (after its cue) and secret (a key after its cue) come from the method; cues count in any case. Spans of one kind never overlap; a span
of the method's own that overlaps a base span is left out, but for urls, which may hold some whole (as a user's name or a host's ip). Null or empty text: no spans. Null ids stay null, repeated rows give
repeated rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "ssn", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_URL = re.compile(r"://[^\s<>\"'`|\\^{}]+")
_IBAN = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:[\x20_-]?(?:no|nr|number|num|id|#)\.?)?[\"']?\x20?(?:[:#=]|is)?\x20?[\"']?([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])", re.IGNORECASE)
_SSN = re.compile(r"(?:[\x20_-]?(?:no|nr|number|num|#))?\.?[\"']?\x20?(?:[:#=]|is)?\x20?[\"']?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.IGNORECASE)
_SECRET = re.compile(r"[\"']?\x20?(?:[:=]|=>|is)\x20?[\"']?([A-Za-z0-9+/_=-]{16,})")
#: Cues, in lower case; a blank in one may be an underscore, a hyphen or nothing in a text.
_CUES = {"iban": "iban", "account": "account", "acct": "account", "ssn": "ssn", "social security": "ssn", "token": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "api key": "secret", "access key": "secret", "secret key": "secret", "private key": "secret"}
_LOWER = {c: c + 32 for c in range(65, 91)}
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, "digit")
        a.add_word("@", "email")
        a.add_word("+", "phone")
        a.add_word("://", "url")
        for cue, kind in _CUES.items():
            for between in " _-":
                a.add_word(cue.replace(" ", between), kind)
            a.add_word(cue.replace(" ", ""), kind)
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _mod97(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """The spans (kind, start, end) of a text, by start, then kind; code points, end exclusive."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    own: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    local_from = 0  # characters before are known to hold no local part for the next at-sign
    run_end = 0
    low = text.lower()
    for end, kind in automaton().iter(low if len(low) == len(text) else text.translate(_LOWER)):
        at = end
        if kind == "digit":
            if at >= after["ip"] and at >= run_end:
                if m := _IP.match(text, at):
                    after["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        spans.append(("ip", at, m.end()))
            if at >= after["card"] and (m := _CARD.match(text, at)):
                after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, m.end()))
            if at >= run_end:
                run_end = _RUN.match(text, at).end()
        elif kind == "email":
            start = at
            while start > local_from and text[start - 1] in _LOCAL:
                start -= 1
            local_from = at + 1
            if start < at and (m := _DOMAIN.match(text, at)):
                spans.append(("email", start, m.end()))
                local_from = m.end()
        elif kind == "phone":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                after["phone"] = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append(("phone", at, m.end()))
        elif kind == "url":
            at -= 2
            if at >= after["url"] and (s := _SCHEME.search(text[max(after["url"], at - 16) : at])) and (m := _URL.match(text, at)):
                stop = m.start() + len(m[0].rstrip(".,;:!?)]*"))
                after["url"] = m.end()
                if stop > at + 3:
                    own.append(("url", at - len(s[0]), stop))
        elif end + 1 >= after[kind]:
            rule = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN, "secret": _SECRET}[kind]
            if m := rule.match(text, end + 1):
                value, start, stop = m[1], m.start(1), m.end(1)
                if kind == "iban":
                    while len(value) >= 15 and not _mod97(value.replace(" ", "")):
                        value = value[:-1].rstrip()
                    if len(value) < 15:
                        continue
                    stop = start + len(value)
                elif kind == "secret" and not re.search("[0-9]", value):
                    continue
                own.append((kind, start, stop))
                after[kind] = stop
    key = lambda s: (s[1], _ORDER[s[0]])
    spans.sort(key=key)
    if own:
        starts, reach, kept = [b[1] for b in spans], list(accumulate((b[2] for b in spans), max)), []
        for s in sorted(own, key=key):
            lo, hi = bisect_left(starts, s[1]), bisect_left(starts, s[2])
            inside = s[0] == "url" and all(b[2] <= s[2] for b in spans[lo:hi])
            if (lo == hi or inside) and (not lo or reach[lo - 1] <= s[1]) and (not kept or kept[-1][2] <= s[1]):
                kept.append(s)
        spans = sorted(spans + kept, key=key)
    return spans


def redacted(text: str | None) -> str | None:
    """The text with each span's characters replaced by its kind in angle brackets; of overlapping spans, the first and longest."""
    if not text or not (spans := find(text)):
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, counts of base kinds, base_sha256, spans, as text 'kind:start:end,...', and their number."""

    def rows(texts: list[str | None]) -> list[tuple]:
        out = []
        for spans in map(find, texts):
            base = [s for s in spans if s[0] in BASE]
            told, all_told = (",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in (base, spans))
            out.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(told.encode()).hexdigest(), all_told, len(spans)))
        return out

    return per_row(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], "text", rows, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each text redacted and n_chars, if there, recounted; all else as it was."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redacted(t) if isinstance(t, str) else None)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
