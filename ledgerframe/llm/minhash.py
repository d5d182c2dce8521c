"""Near-duplicate documents by MinHash bands, odd sketches and full shingle sets.

Words are runs of bytes other than white space, A-Z in lower case; a document's set has its distinct shingles of SHINGLE words.
Documents with one sequence of words (by a cryptographic digest of 128 bits) form a class, held by its smallest doc_id, so that exact
copies cost one row each. Class holders get ROWS * BANDS MinHash values. Holders that agree on a band are candidates; their odd
sketches (a bitmap in which each MinHash value flips one bit, so that the population count of an XOR follows the number of values
that differ) drop candidates which a pair of similarity THRESHOLD all but never gives (chance about 1e-8); the rest is confirmed on
full sets, made anew from the texts: first on 64-bit hashes of the shingles, then, before it counts as a link, on the words themselves.

No bucket is expanded into all its pairs. Its members are dealt into blocks of about BLOCK; in a block each member proposes at most two
partners: the block's leader, the member with most candidates (so nearest to the middle of a group of copies), and the member with
the nearest sketch; most copies of a group are joined so at a cost in proportion to their number. Confirmed links are contracted to
components. What is then still in different components of one bucket is compared in full, block by block and without a row for a
pair: members outside a bucket's largest component with each other and with all of that component. Where that would be more than
PAIRS comparisons a member, members of such buckets are first dealt anew and propose the nearest sketch of another component (at most
DEALS times). A pair is met only in the first of the bands that it shares. Pairs in one component can't change it.

A leader's text goes once to each chunk of the members that propose it (CHUNK shingles a chunk, by a bound on what may propose it),
not once a pair; chunks are spread by their hash.

A pair at the threshold is missed by all bands with chance (1 - 0.8^4)^24 = 3e-6. Null or empty texts, or texts of white space:
n_shingles 0, linked with nothing. Rows with a null doc_id: a component of their own (null), kept. Repeated rows: each row
is returned, with the class of its text. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, give_back, slices, table, unplaced, whole_groups, wide
from .hashing import joined, mix, word_hashes, words

SHINGLE, THRESHOLD, BANDS, ROWS, BITS = 2, 80, 24, 4, 512
#: At most so many bits of two odd sketches differ at similarity 0.8, but for a chance of about 1e-8.
FLIPPED = 77
#: With at most so many a leader is near enough, and no nearer member is looked for.
SURE = 24
DEALS, PAIRS = 4, 2000
#: Members of a bucket in a block, and shingles of a block or a chunk, on average.
BLOCK, CHUNK = 256, 50_000
#: What a row costs besides its shingles, in shingles.
ROW = 100
_INSIDE = np.ones(256, bool)
_INSIDE[[32, 10]] = False


def split(text: str | bytes | None) -> list[bytes]:
    """The words of a text."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def hashed(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of texts in which single spaces divide words, text after text and sorted in each, and where each text's begin (one more at the end)."""
    data, starts = joined(texts)
    s, e = words(data, _INSIDE)
    h = word_hashes(data, s, e)
    doc = np.searchsorted(starts, s, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(len(h), np.uint64)
    m = max(len(h) - n + 1, 0)
    for k in range(n):
        out[:m] = out[:m] * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    full = np.zeros(len(h), bool)
    full[:m] = doc[:m] == doc[n - 1 : n - 1 + m] if m else False
    for i in np.flatnonzero((count > 0) & (count < n)):  # fewer words: the sequence is the one shingle
        at, x = first[i], np.uint64(count[i])
        for y in h[at : first[i + 1]]:
            x = mix(x + y)
        out[at], full[at] = x, True
    out, doc = mix(out[full]), doc[full]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(texts) + 1))


def shingles(line: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text, given by its words."""
    return set(zip(*(line[k:] for k in range(n)))) if len(line) >= n else {tuple(line)} if line else set()


def alike(a: set, b: set) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a digest of the words (h1, h2), BANDS band keys and the odd sketch (8 numbers of 64 bits)."""
    k = BANDS * ROWS
    a = mix(np.arange(1, k + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    b = mix(np.arange(1001, k + 1001, dtype=np.uint64)).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, texts in slices(batch.column("text").to_pylist(), 1 << 20):
                texts = [b" ".join(split(t)) for t in texts]
                digest = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
                sh, first = hashed(texts, n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                least = np.zeros((len(texts), k), np.uint32)
                if len(some):
                    low = (sh >> np.uint64(32)).astype(np.uint32) ^ sh.astype(np.uint32)
                    for i in range(k):
                        x = low * a[i]
                        x += b[i]
                        x ^= x >> np.uint32(15)
                        x *= np.uint32(0x2C1B3C6D)
                        least[some, i] = np.minimum.reduceat(x, first[:-1][some])
                bands = np.zeros((len(texts), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + least[:, r::ROWS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
                bit = mix(least.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
                odd = np.zeros((len(texts), BITS), np.uint8)
                for i in range(k):
                    odd[np.arange(len(texts)), bit[:, i]] ^= 1
                parts.append((size, digest[:, 0], digest[:, 1], bands.view(np.int64), np.packbits(odd, axis=1).view(np.int64)))
            if parts:
                size, h1, h2, bands, sketch = (np.concatenate(x) for x in zip(*parts))
                fixed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(h1), pa.array(h2), fixed(bands), fixed(sketch)], ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>")


def _flipped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each of sketches a differs from each of b."""
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether set sizes a and b allow the threshold."""
    return 100 * np.minimum(a, b) >= THRESHOLD * np.maximum(a, b)


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, width)


def _dealt(rows: DataFrame, by: list) -> DataFrame:
    """rows with those of one group, by the hash of by, together and in order of group."""
    return rows.withColumn("group", F.xxhash64(*by)).repartition(wide(rows), "group").sortWithinPartitions("group")


def _proposals(rows: DataFrame, leaders: bool) -> DataFrame:
    """Distinct pairs (a, b) that a block's members propose, b the one with more candidates, the chunk of b that a belongs to, and (ao, bo) their order by candidates.

    leaders: each member's leader, and the nearest sketch if the leader isn't near; else the nearest sketch of another component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, "group"):
            ids, size, p, group, c = (x.column(k).to_numpy() for k in ("doc_id", "n_shingles", "p", "group", "c"))
            sketch = _lists(x.column("sketch"), BITS // 64)
            order = np.lexsort((ids, -p, group))
            ids, size, p, group, c, sketch = (v[order] for v in (ids, size, p, group, c, sketch))
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            count = np.diff(np.append(first, len(ids)))
            one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            unsure = np.ones(len(ids), bool)
            if leaders:
                lead = np.repeat(first, count)
                flips = np.bitwise_count(sketch ^ sketch[lead]).sum(1, dtype=np.int64)
                ok = np.flatnonzero((flips <= FLIPPED) & (ids != ids[lead]) & _fit(size, size[lead]))
                one.append(ok)
                other.append(lead[ok])
                unsure = (flips > SURE) | (ids == ids[lead])
            for at, n in zip(first[count > 1 + leaders].tolist(), count[count > 1 + leaders].tolist()):
                g = slice(at, at + n)
                if leaders:
                    own = np.flatnonzero(unsure[g])
                else:
                    names, k = np.unique(c[g], return_counts=True)
                    if len(names) < 2:
                        continue
                    own = np.flatnonzero(c[g] != names[np.argmax(k)])
                if not len(own):
                    continue
                flips = _flipped(sketch[g][own], sketch[g])
                flips[~_fit(size[g][own][:, None], size[g][None, :])] = BITS
                flips[(ids[g][own][:, None] if leaders else c[g][own][:, None]) == (ids[g] if leaders else c[g])[None, :]] = BITS
                best = flips.argmin(1)
                ok = flips[np.arange(len(own)), best] <= FLIPPED
                one.append(at + own[ok])
                other.append(at + best[ok])
            one, other = np.concatenate(one), np.concatenate(other)
            more = (p[one] > p[other]) | ((p[one] == p[other]) & (ids[one] < ids[other]))
            a, b = np.where(more, other, one), np.where(more, one, other)
            chunks = np.maximum(p[b] // (BANDS * CHUNK), 1)
            chunk = (mix(ids[a].astype(np.uint64)) % chunks.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(chunk), pa.array(-p[a]), pa.array(-p[b])], ["a", "b", "chunk", "ao", "bo"])
        give_back()

    return rows.mapInArrow(run, "a long, b long, chunk long, ao long, bo long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Of pairs (a, b, chunk, ao, bo), those whose full sets confirm the threshold."""
    asked = pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("of"), "chunk", F.lit(1).alias("turn"), "ao", "bo")
    asked = asked.union(pairs.select(F.col("b").alias("doc_id"), F.col("b").alias("of"), "chunk", F.lit(0).alias("turn"), F.col("bo").alias("ao"), "bo").distinct())
    rows = asked.join(texts, "doc_id").select("of", "chunk", "turn", "doc_id", "ao", "bo", "text")
    rows = rows.repartition(wide(pairs), "of", "chunk").sortWithinPartitions("of", "chunk", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs = None, []  # the group, and of its leader's text (or texts, if the id has several) hashes, words and shingles
        for batch in batches:
            ids, of, chunk, turn, ao, bo = (batch.column(c).to_numpy() for c in ("doc_id", "of", "chunk", "turn", "ao", "bo"))
            hit = []
            for at, some in slices(batch.column("text").to_pylist(), 1 << 20):
                lines = [split(t) for t in some]
                sh, first = hashed([b" ".join(x) for x in lines], n)
                for i, line in enumerate(lines):
                    k, own = at + i, sh[first[i] : first[i + 1]]
                    if (of[k], chunk[k]) != now:
                        now, hubs = (of[k], chunk[k]), []
                    if not turn[k]:
                        hubs.append([own, line, None])
                        continue
                    for hub in hubs:
                        place = np.searchsorted(hub[0], own)
                        both = int((hub[0][np.minimum(place, len(hub[0]) - 1)] == own).sum())
                        if both and 100 * both >= THRESHOLD * (len(own) + len(hub[0]) - both):
                            hub[2] = hub[2] or shingles(hub[1], n)
                            if alike(shingles(line, n), hub[2]):
                                hit.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(v[hit]) for v in (ids, of, ao, bo)], ["a", "b", "ao", "bo"])
        give_back()

    return cut(rows.mapInArrow(run, "a long, b long, ao long, bo long"))


def _rest(rows: DataFrame, tops: DataFrame, holders: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components; of a member's links to one component, one.

    rows: key, doc_id, c; tops: key, top (its largest component), blocks of the others and of top's members.
    """
    rows = rows.join(tops, "key").withColumn("is_top", F.expr("c = top"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.expr("if(is_top, tops, others)")))
    # (lo, hi): two blocks of others, lo <= hi, or a block of others and, as -1 - hi, one of the top's. Side 0: left, 1: right, 2: both.
    meets = """if(is_top, transform(sequence(0l, others - 1), i -> named_struct('lo', i, 'hi', -1 - own, 'side', 1)),
        concat(transform(sequence(0l, others - 1), i -> named_struct('lo', least(i, own), 'hi', greatest(i, own), 'side', if(i = own, 2, if(own < i, 0, 1)))),
               transform(sequence(1l, tops), i -> named_struct('lo', own, 'hi', -i, 'side', 0))))"""
    rows = rows.withColumn("m", F.explode(F.expr(meets))).select("key", "m.*", "doc_id", "c")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, "group"):
            group, key, side, size, c = (x.column(k).to_numpy() for k in ("group", "key", "side", "n_shingles", "c"))
            sketch, bands = _lists(x.column("sketch"), BITS // 64), _lists(x.column("bands"), BANDS).view(np.int64)
            keep = np.zeros(x.num_rows, bool)
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for lo, hi in zip(edge[:-1], edge[1:]):
                left, right = lo + np.flatnonzero(side[lo:hi] != 1), lo + np.flatnonzero(side[lo:hi] != 0)
                for at in range(0, len(left), 256):
                    own = left[at : at + 256]
                    i, j = np.nonzero((c[own][:, None] != c[right][None, :]) & _fit(size[own][:, None], size[right][None, :]) & (_flipped(sketch[own], sketch[right]) <= FLIPPED))
                    i, j = own[i], right[j]
                    for k in range(0, len(i), 1 << 16):
                        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                        here = bands[p, (bands[p] == bands[q]).argmax(1)] == key[p]
                        keep[p[here]] = keep[q[here]] = True
            yield x.filter(pa.array(keep)).select(["group", "side", "doc_id", "c"])
        give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, "group"):
            a, b = [], []
            groups, sides, every, named = (x.column(k).to_numpy() for k in ("group", "side", "doc_id", "c"))
            lines = [split(t) for t in x.column("text").to_pylist()]
            edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
            for lo, hi in zip(edge[:-1], edge[1:]):
                ids, c, side = every[lo:hi], named[lo:hi], sides[lo:hi]
                sh, first = hashed([b" ".join(t) for t in lines[lo:hi]], n)
                size = np.diff(first)
                _, number = np.unique(sh, return_inverse=True)
                holder = np.repeat(np.arange(len(ids)), size)[np.argsort(number, kind="stable")]
                start = np.concatenate([[0], np.cumsum(np.bincount(number))])
                sets: dict[int, set] = {}
                for i in np.flatnonzero(side != 1):
                    own = number[first[i] : first[i + 1]]
                    k = start[own + 1] - start[own]
                    both = np.bincount(holder[np.repeat(start[own] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))], minlength=len(ids))
                    met: set = set()
                    for j in np.flatnonzero((100 * both >= THRESHOLD * (size[i] + size - both)) & (c != c[i]) & (side != 0)):
                        if c[j] not in met:
                            for m in (i, j):
                                if m not in sets:
                                    sets[m] = shingles(lines[lo + m], n)
                            if alike(sets[i], sets[j]):
                                met.add(c[j])
                                a.append(ids[i])
                                b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    some = _dealt(rows.join(holders.select("doc_id", "n_shingles", "sketch", "bands"), "doc_id"), ["key", "lo", "hi"])
    some = cut(some.mapInArrow(may, "group long, side int, doc_id long, c long"))
    full = some.join(texts, "doc_id").repartition(wide(rows), "group").sortWithinPartitions("group")
    return cut(full.mapInArrow(compare, "a long, b long").distinct())


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """label (node, component) with links (a, b) taken in; None as long as there is no link."""
    if label is not None:  # links between components found so far
        for side in ("a", "b"):
            links = links.select("a", "b").join(label, links[side] == label.node, "left").withColumn(side, F.coalesce("component", side)).drop("node", "component")
    more = cut(components(links))
    if label is None or more.isEmpty():
        return label if label is not None else more
    # The old components' new ones, and the new ones of documents that were alone.
    moved = label.alias("l").join(more.alias("m"), F.col("l.component") == F.col("m.node"), "left").select("l.node", F.coalesce("m.component", "l.component").alias("component"))
    return cut(moved.union(more.join(label, "node", "left_anti")))


def near_duplicates(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text); shingles of n words."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = cut(signatures(docs, n))
    real = rows.where("doc_id is not null and n_shingles > 0")
    classes = cut(real.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("x")).select("h1", "h2", "x.*"))
    banded = classes.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("n_shingles") + ROW).alias("weight")).where("n > 1").select(unplaced("key"), "n", "weight")
    members = cut(banded.select("key", "doc_id").join(shared, "key"))
    rank = members.groupBy("doc_id").agg(F.sum("weight").alias("p"))  # the more candidates, the nearer to a group's middle
    holders = cut(classes.select("doc_id", "n_shingles", "bands", "sketch").join(rank, "doc_id"))
    texts = docs.where("doc_id is not null")
    size = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / (32 * CHUNK))).cast("long")
    in_blocks = members.select("key", "doc_id", size.alias("blocks"))
    slot = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), "blocks")
    blocked = lambda x, k: _dealt(x.withColumn("slot", slot(k)).join(holders.drop("bands"), "doc_id"), ["key", "slot"])

    pairs = cut(_proposals(blocked(in_blocks.withColumn("c", F.col("doc_id")), 0), True))
    label = _merged(None, _confirmed(pairs, texts, n))
    deals = 0
    while True:
        # Only buckets that hold several components are looked at again.
        named = in_blocks.join(label, in_blocks.doc_id == label.node, "left").select("key", "doc_id", "blocks", F.coalesce("component", "doc_id").alias("c"))
        mixed = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select(unplaced("key"))
        now = cut(named.join(mixed, "key"))
        each = now.groupBy("key", "c").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks")).groupBy("key")
        tops = each.agg(F.max(F.struct("n", "c")).alias("t"), F.sum("n").alias("n"), F.max("blocks").alias("blocks"))
        tops = cut(tops.select(unplaced("key"), "n", "blocks", F.col("t.c").alias("top"), F.col("t.n").alias("m"), F.expr("n - t.n").alias("l")))
        work, n_now = tops.agg(F.sum(F.expr("cast(l as double) * (m + l / 2)")), F.sum("n")).first()
        if not n_now:
            break
        in_blocks = now.drop("c")
        if work > PAIRS * n_now and deals < DEALS:
            deals += 1
            new = cut(_proposals(blocked(now, deals), False).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
            label = _merged(label, _confirmed(new, texts, n))
            continue
        share = lambda x: F.ceil(F.col("blocks") * F.col(x) / F.col("n")).cast("long")
        tops = tops.select("key", "top", share("l").alias("others"), share("m").alias("tops"))
        label = _merged(label, _rest(now.select("key", "doc_id", "c"), tops, holders, texts, n))
        break
    named = classes.select("h1", "h2", F.col("doc_id").alias("holder")).join(label, F.col("holder") == label.node, "left")
    named = named.select("h1", "h2", F.coalesce("component", "holder").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "h1", "h2", F.expr("if(n_shingles > 0, h1, null)").alias("k1")).alias("r")
    out = out.join(named.alias("c"), (F.col("r.k1") == F.col("c.h1")) & (F.col("r.h2") == F.col("c.h2")), "left")
    out = out.select("r.doc_id", "r.n_shingles", F.expr("if(r.doc_id is null, null, coalesce(c.component_id, r.doc_id))").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id is null or doc_id = component_id"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') w from documents),
 s as (select doc_id, case when len(w) < {SHINGLE} then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end sh from w),
 n as (select doc_id, len(sh)::bigint n from s),
 x as (select doc_id, unnest(sh) t from s),
 c as (select p.doc_id a, q.doc_id b, count(*) c from x p join x q on p.t = q.t and p.doc_id < q.doc_id group by all),
 e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= {THRESHOLD} * (na.n + nb.n - c)),
 l as (select a, b from e union all select b, a from e),
 r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on r.b = l.a),
 m as (select a doc_id, min(b) component_id from r group by a)
select doc_id, n n_shingles, component_id, doc_id = component_id kept from n join m using (doc_id)"""
