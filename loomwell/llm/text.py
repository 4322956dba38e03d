"""Words and word shingles of whole texts, hashed in blocks with NumPy.

A word is a maximal run of bytes other than space and the bytes 9 to 13; A-Z count as a-z. Words
are hashed by a polynomial over their bytes modulo 2**64 and then mixed. All functions take whole
texts; blocks only bound memory and never cut a word or a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BLOCK = 1 << 19
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, _BLOCK + (1 << 14))
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        _powers[kind] = np.multiply.accumulate(factors)
    return _powers[kind]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of every row."""
    n = len(offs) - 1
    hashes, counts = [], np.zeros(n, np.int64)
    border = np.zeros(len(data) + 1, bool)
    border[offs] = True
    a = 0
    while a < len(data):
        b = min(len(data), a + _BLOCK)
        while b < len(data) and not (_SPACE[data[b]] or border[b]):
            more = data[b : b + 4096]
            stop = np.flatnonzero(_SPACE[more] | border[b : b + len(more)])
            b += int(stop[0]) if len(stop) else len(more)
        part = data[a:b]
        word = ~_SPACE[part]
        edge = border[a : b + 1]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        total = _LOWER[part]
        total *= _power("up", _BASE, len(part))[: len(part)]
        np.cumsum(total, out=total)
        before = total[s - 1]
        if len(s) and s[0] == 0:
            before[0] = 0
        h = (total[e] - before) * _power("down", _BASE_INVERSE, len(part))[s]
        h += (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        hashes.append(mix(h))
        counts += np.bincount(np.searchsorted(offs, s + a, side="right") - 1, minlength=n)[:n] if len(s) else 0
        a = b
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every five-word shingle, repeats included, and the offsets of the rows.

    A row of one to four words has its whole sequence as its one shingle; a row without words, none.
    """
    words, counts = word_hashes(*utf8(column))
    starts = np.concatenate([[0], np.cumsum(counts)])
    values = np.zeros(len(words), np.uint64)
    if len(words) >= SHINGLE:
        m = len(words) - SHINGLE + 1
        for j in range(SHINGLE):
            values[:m] += words[j : j + m] * _PLACE[j]
    row = np.repeat(np.arange(len(counts)), counts)
    valid = np.arange(len(words)) + SHINGLE <= starts[1:][row] if len(words) else np.zeros(0, bool)
    for k in range(1, SHINGLE):
        s = starts[:-1][counts == k]
        if len(s):
            values[s] = np.uint64(k)
            for j in range(k):
                values[s] += words[s + j] * _PLACE[j]
            valid[s] = True
    per_row = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    return mix(values[valid]), np.concatenate([[0], np.cumsum(per_row)])
