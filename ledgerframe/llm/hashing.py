"""Prefix polynomial hashes of byte strings with numpy: the hash of any span takes constant time.

h(s..e) = sum of T[byte i] * B^(i - s) modulo 2^64, T a table of 64-bit numbers made by a rule and B odd, so that it has an
inverse; mix() then spreads the bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: The same number for A-Z as for a-z.
CASELESS = BYTES.copy()
CASELESS[65:91] = BYTES[97:123]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, b in enumerate((BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)


def prefix(data: np.ndarray, numbers: np.ndarray = BYTES) -> np.ndarray:
    """For spans(): one more entry than data has bytes."""
    n = len(data)
    _grow(n + 1)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(numbers[data] * _powers[0][:n], out=h[1:])
    return h


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * _powers[1][start])


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which inside (256 booleans) is true."""
    m = np.zeros(len(data) + 2, np.int8)
    m[1:-1] = inside[data]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


#: Longer words are known by a digest of their own.
LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data as a number, zeros beyond its end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


_OF_LENGTH = mix(np.arange(1, LONG + 2, dtype=np.uint64))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each span of data: its length, then 8 bytes at a time, mixed; no sum of terms by place, so that no family of words collides.

    Of words of one length of at most 8 bytes no two are equal.
    """
    n, eight = e - s, eights(data)
    h = mix(_OF_LENGTH[np.minimum(n, LONG)] ^ (eight[s] & _MASK[np.minimum(n, 8)]))
    on = np.flatnonzero(n > 8)
    for k in range(8, LONG, 8):
        if not len(on):
            break
        h[on] = mix(h[on] ^ (eight[s[on] + k] & _MASK[np.minimum(n[on] - k, 8)]))
        on = on[n[on] > k + 8]
    for i in on:
        h[i] = int.from_bytes(hashlib.blake2b(data[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each span is, byte by byte, that with the number in first, which has the same word_hashes()."""
    n = e - s
    ok = n == n[first]
    on = np.flatnonzero(ok & (n > 8) & (first != np.arange(len(first))))  # shorter ones of one length and hash are equal
    eight = eights(data)
    for k in range(0, LONG, 8):
        if not len(on):
            break
        t = s[first[on]]
        ok[on] = ((eight[s[on] + k] ^ eight[t + k]) & _MASK[np.minimum(n[on] - k, 8)]) == 0
        on = on[ok[on] & (n[on] > k + 8)]
    for i in on:
        t = s[first[i]]
        ok[i] = data[s[i] : e[i]].tobytes() == data[t : t + n[i]].tobytes()
    return ok


def joined(texts: list[bytes], between: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, with one byte after each, and their starts (one more at the end)."""
    data = np.frombuffer(between.join(texts) + between, np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts
