"""Vectorised text kernels shared by the corpus operators.

Texts arrive as Arrow string arrays. Whole texts are hashed word by word in numpy without making
a Python object for each word: a byte table lower-cases A-Z and marks separators, a prefix sum of
``T[byte] * P**position`` gives every word's polynomial hash, and a finaliser mixes it with the
word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SLICE = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_P = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def seeds64(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values that look random, from a rule."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=_U) * _U(_ODD) + mix64(np.array([seed], _U))[0])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, _U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_BYTE = seeds64(256, 11)
_pow: list[np.ndarray] = [_powers(_P, _SLICE), _powers(pow(_P, -1, 1 << 64), _SLICE)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    if n > len(_pow[0]):
        _pow[:] = [_powers(_P, 2 * n), _powers(pow(_P, -1, 1 << 64), 2 * n)]
    return _pow[0], _pow[1]


def _table(is_word) -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return np.where([is_word(b) for b in range(256)], low, 0).astype(np.uint8)


#: Words are runs of anything but the six ASCII white-space characters; A-Z in lower case.
SPACED = _table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: 0 marks separators in the tables, so a NUL byte, which is part of a word here, becomes a code that no other byte has.
SPACED[0] = 0x0B
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = _table(lambda b: b >= 128 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)


def spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its rows in them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, most: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each row (and the end), and starts and ends of the runs of nonzero bytes; no run crosses rows."""
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(len(off), np.int64), z, z
    inside = low != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < n]
    begin[edge] = inside[edge]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    finish[last] = inside[last]
    s = np.flatnonzero(begin)
    return np.searchsorted(s, off), s, np.flatnonzero(finish) + 1


def hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings low[s:e]."""
    n = len(low)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[low] * up[:n], out=acc[1:])
        return mix64((acc[e] - acc[s]) * down[s] + (e - s).astype(_U) * _U(_ODD))


def words(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with these offsets: word hashes, first word of each row (and the end), and byte starts and ends of the words."""
    low = table[raw[int(off[0]) : int(off[-1])]]
    first, s, e = word_spans(low, np.asarray(off, np.int64) - int(off[0]))
    return hashes(low, s, e), first, s, e


def hash_of(word: str) -> np.uint64:
    """The hash that ``words`` gives a word."""
    low = np.frombuffer(word.encode(), np.uint8)
    return hashes(low, np.array([0]), np.array([len(low)]))[0]


_STEP = seeds64(64, 12)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each row in word order, and the first of each row (and the end).

    A row of fewer than k words, but one at least, has its whole word sequence as its only shingle.
    """
    n, rows = len(h), len(first) - 1
    count = np.diff(first)
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_first = np.zeros(rows + 1, np.int64)
    np.cumsum(each, out=out_first[1:])
    if not out_first[-1]:
        return np.zeros(0, _U), out_first
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1] - first[:-1], each)
    room = np.repeat(first[1:], each) - at
    with np.errstate(over="ignore"):
        acc = np.full(len(at), 0, _U)
        for j in range(k):
            part = mix64(h[np.minimum(at + j, n - 1)] + _STEP[j % 64] * _U(j // 64 + 1))
            acc += part if j == 0 else np.where(room > j, part, _U(0))
        acc += np.minimum(room, k).astype(_U) * _U(_P)
    return mix64(acc), out_first


def text_digests(raw: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's word sequence (0 without words): equal texts have equal digests."""
    rows = len(first) - 1
    out = np.zeros(rows, _U)
    if not len(h):
        return out
    up, down = powers(len(h) + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h) + 1, _U)
        np.cumsum(h * up[: len(h)], out=acc[1:])
        d = mix64((acc[first[1:]] - acc[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(_U))
    return np.where(np.diff(first) > 0, d, _U(0))
