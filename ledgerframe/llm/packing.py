"""Best-fit packing of documents into sequences of at most SIZE tokens, after dominance reduction.

Documents become ids and a closing id; longer ones are cut. Only how many pieces there are of each length (at most SIZE numbers)
comes to the driver. There the instance is reduced as by Martello and Toth: for the largest piece, a set of at most three pieces that
dominates every other set with it is fixed for good as a sequence (every other set's pieces could be put in the place of larger or
equal ones of it), and what is left is looked at again until no rule applies to any piece. The rules are in dominating(). The
remainder is packed by best fit, longest first; equal lengths move in bulk, so the work follows
lengths, not documents. The plan says, for each length, which ranks go to which sequences; its size is bounded by the number of
lengths. Pieces are ranked within their length in slices by a hash of the id, so no length's pieces meet in one task.

Null or empty text: only the closing id. Null doc_id: kept as null. Repeated rows: each is packed. Ties (equal lengths)
go by slice, doc_id, piece and start. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, table
from .hashing import joined, same_words, word_hashes

SIZE, END, TOKENIZER, SLICE = 4096, 1, "word_bpe_49k.json", 4096
#: Words whose ids a Python worker remembers.
REMEMBERED = 400_000
_tokenizers: dict[str, Words] = {}
#: What Words doesn't cut into words itself: contractions, special tokens, a capital sigma, and characters beyond ASCII that
#: aren't lower-case letters of the Latin, Greek and Cyrillic blocks.
_ODD = re.compile("'(?:[stmd]|re|ve|ll)|<\\||[^\\x00-\\x7f\u00df-\u00f6\u00f8-\u00ff\u0101-\u017f\u03b1-\u03c1\u03c3-\u03c9\u0430-\u045f]")
#: Classes of bytes: white space, letters, digits, all else.
_CLASS = np.array([0 if 9 <= c <= 13 or c == 32 else 1 if 97 <= c <= 122 or c >= 128 else 2 if 48 <= c <= 57 else 3 for c in range(256)], np.int8)


class Words:
    """A tokenizer of the word_bpe kind: NFC, lower case, words (letters, one digit, or a run of other signs) and pairs inside them.

    Words are found with numpy and told apart by a 64-bit hash; each is compared byte by byte with the first of its hash, and texts
    where they differ are encoded whole. Words are remembered by their bytes. The tokenizer itself encodes those not met before, many at
    a time: an id that ends a word closes its word's ids. A text with anything in which its rules for words go beyond that is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        self.ends[[i for w, i in self.whole.get_vocab().items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start = np.zeros(REMEMBERED + 1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 5000):
            some = [w.decode() for w in words[at : at + 5000]]
            ids = np.array(self.whole.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(some):
                each = [self.whole.encode(w, add_special_tokens=False).ids for w in some]
                ids, stop = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            n = len(self.slot)
            self.start[n + 1 : n + 1 + len(some)] = self.used + stop
            self.slot.update(zip(words[at : at + 5000], range(n, n + len(some))))
            self.used += len(ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids."""
        plain = [unicodedata.normalize("NFC", t).lower() if t and "\u03a3" not in t else "" for t in texts]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, (t, p) in enumerate(zip(texts, plain)):
            if t and (not p or _ODD.search(p)):
                out[i], plain[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32), ""
        data, starts = joined([p.encode() for p in plain])
        c = np.zeros(len(data) + 2, np.int8)
        c[1:-1] = _CLASS[data]
        change = np.flatnonzero((c[1:] != c[:-1]) | (c[1:] == 2))
        s, e = change[:-1], change[1:]
        keep = c[s + 1] > 0
        s, e = s[keep], e[keep]
        if not len(s):
            return out
        _, first, inverse = np.unique(word_hashes(data, s, e), return_index=True, return_inverse=True)
        other = np.flatnonzero(~same_words(data, s, e, first[inverse]))
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())]
        if len(self.slot) + len(keys) > REMEMBERED or self.used > 16 * REMEMBERED:
            self.forget()
        new = [w for w in keys if w not in self.slot]
        if len(new) > REMEMBERED:  # one very long text
            for i, (t, p) in enumerate(zip(texts, plain)):
                if p:
                    out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            return out
        self._learn(new)
        get = self.slot.__getitem__
        slot = np.fromiter(map(get, keys), np.int64, len(keys))[inverse]
        n = self.start[slot + 1] - self.start[slot]
        at = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.start[slot] - at[:-1], n) + np.arange(at[-1])]
        bound = at[np.searchsorted(s, starts)]
        for i, p in enumerate(plain):
            if p:
                out[i] = ids[bound[i] : bound[i + 1]]
        for i in set((np.searchsorted(starts, s[other], "right") - 1).tolist()):  # words of equal hashes that differ
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def _words(path: str) -> Words:
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row; tokenizer: a file's path, or its name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(_path(tokenizer))
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(ids):
                to, n = at, 0
                while to < len(ids) and (to == at or n + len(texts[to] or "") <= 1 << 20):
                    n += len(texts[to] or "")
                    to += 1
                rows = []
                for doc, own in zip(ids[at:to], words.encode(texts[at:to])):
                    data = np.append(own, np.uint32(end)).astype("<u4").tobytes()
                    for k, start in enumerate(range(0, len(data), 4 * size)):
                        piece = data[start : start + 4 * size]
                        rows.append((doc, k, start // 4, len(piece) // 4, zlib.crc32(piece)))
                at = to
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def dominating(left: Counter, present: list[int], big: int, size: int) -> tuple[int, ...] | None:
    """The lengths of a set with a piece of length big that dominates every other feasible set with it, if one of at most three is known to.

    left: pieces of each length; present: the lengths in order. The rules, by how many of the smallest others fit beside it at
    once: none, it stays alone; one, it goes with the largest that fits; two, with the largest that fits if no pair that fits is
    larger, or with the largest pair if that has the largest that fits and no two that lie between the pair's lengths fit. Whatever
    that number, a partner that fills the sequence dominates.
    """
    room = size - big
    count = lambda x: left[x] - (x == big)

    def smallest(at: int, n: int, below: int) -> list[int]:
        out: list[int] = []
        while at < len(present) and present[at] < below and len(out) < n:
            out += [present[at]] * min(count(present[at]), n - len(out))
            at += 1
        return out

    def largest(most: int, without: int = 0) -> int:
        for at in range(bisect_right(present, most) - 1, -1, -1):
            if count(present[at]) > (present[at] == without):
                return present[at]
        return 0

    least = smallest(0, 3, room + 1)
    if not least:
        return (big,)
    partner = largest(room)
    if len(least) == 1 or least[0] + least[1] > room or partner == room:
        return (big, partner)
    if len(least) == 2 or sum(least) > room:
        pair, at = 0, 0
        for x in reversed(present[: bisect_right(present, room)]):  # the largest sum of two that fit
            if count(x):
                while at < len(present) and present[at] <= room - x:
                    at += 1
                other = next((y for y in reversed(present[:at]) if count(y) > (y == x)), 0)
                pair = max(pair, x + other if other else 0)
        if partner >= pair:
            return (big, partner)
        other = largest(room - partner, partner)
        if other and partner + other == pair:
            between = smallest(bisect_right(present, other), 2, partner)
            if len(between) < 2 or sum(between) > room:
                return (big, partner, other)
    return None


def reduction(lengths: dict[int, int], size: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """The sets that are fixed, each with how often, and the pieces of each length that are left."""
    left = Counter({n: k for n, k in lengths.items() if k > 0})
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        present = sorted(left)
        for big in reversed(present.copy()):
            while left[big] and (found := dominating(left, present, big, size)):
                need = Counter(found)
                # As long as three of each are left the rules see the same; a piece that stays alone changes nothing for its like.
                times = left[big] if len(found) == 1 else max(1, min((left[x] - 3) // m for x, m in need.items()))
                fixed.append((found, times))
                for x, m in need.items():
                    left[x] -= m * times
                    if not left[x]:
                        del left[x]
                        present.remove(x)
                again = True
    return fixed, left


def plan(lengths: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """How to pack so many pieces of each length: rows (length, first rank, ranks, pieces a sequence, first sequence, offset), and the number of sequences.

    Rank r of a row is in sequence first + (r - first rank) // pieces, at offset + length * ((r - first rank) % pieces).
    """
    used: Counter = Counter()
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    fixed, left = reduction(lengths, size)

    def put(length: int, n: int, each: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n, each, first, offset))
        used[length] += n

    for found, times in fixed:
        offset = 0
        for x, m in Counter(found).items():
            put(x, m * times, m, sequences, offset)
            offset += x * m
        sequences += times

    def take(length: int, n: int, each: int, first: int, offset: int) -> None:
        put(length, n, each, first, offset)
        left[length] -= n

    # Best fit of the remainder, longest first: sequences by room, in bulk.
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        while left[length]:
            n = left[length]
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = size // length
                full, rest = divmod(n, each)
                if full:
                    take(length, full * each, each, sequences, 0)
                    rooms[size - each * length].append((sequences, full))
                    sequences += full
                if rest:
                    take(length, rest, rest, sequences, 0)
                    rooms[size - rest * length].append((sequences, 1))
                    sequences += 1
                continue
            first, count = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = room // length
            full = min(count, n // each)
            if full:
                take(length, full * each, each, first, size - room)
                rooms[room - each * length].append((first, full))
                if full < count:
                    rooms[room].append((first + full, count - full))
            else:
                take(length, n, n, first, size - room)
                rooms[room - n * length].append((first, 1))
                if count > 1:
                    rooms[room].append((first + 1, count - 1))
    return rows, sequences


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """Each piece of docs (doc_id, text) with sequence_id and offset."""
    spark = docs.sparkSession
    cutup = cut(pieces(docs, tokenizer, size))
    lengths = {r.length: r.n for r in cutup.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    rows, _ = plan(lengths, size)
    slices = max(1, sum(lengths.values()) // SLICE)
    sliced = cutup.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    sums = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = sliced.withColumn("k", F.row_number().over(within) - 1).join(sums, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("k"))
    by: dict[int, list] = defaultdict(list)
    for length, *rest in rows:
        by[length].append(rest)
    table_ = {n: np.array(x, np.int64) for n, x in by.items()}  # bounded: rows follow from the number of lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                n = int(length[at[0]])
                own = table_[n]
                row = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 3] + k // row[:, 2]
                offset[at] = row[:, 4] + n * (k % row[:, 2])
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
