"""Word and shingle hashes of whole Arrow text columns, without per-word Python.

A word is a maximal run of bytes other than space and 0x09-0x0D, after lower
case of A-Z.  Hashes come from one running sum over the UTF-8 bytes (a random
64-bit value per byte times a power of an odd base, modulo 2**64): the hash of
any word is a difference of two sums, shifted back by the inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is taken whole.
CHUNK = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything ASCII but letters and digits, for callers that compare words without punctuation.
_PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK + 4096), base, dtype=np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a text column: (first row, end row, UTF-8 bytes, offsets in them). Null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each text (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    gap = np.empty(n + 1, dtype=bool)
    gap[:n] = (_SPACE if punctuation else _PUNCT)[data]
    gap[n] = True
    inside = ~gap[:n]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= gap[: n - 1]
    ends &= gap[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
    h = (total[e] - total[s]) * _power(_INVERSE, n)[s]
    return mix(h + (e - s).astype(np.uint64)), np.searchsorted(s, offsets, side="left")


def shingles(h: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the text each belongs to, in order.

    A text with 1 to k-1 words has its whole sequence as its only run; one
    without words has none.
    """
    texts = len(before) - 1
    owner = np.repeat(np.arange(texts), np.diff(before))
    m = len(h) - k + 1
    out, who = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if m > 0:
        out = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            out += h[j : j + m] * _power(0xA24BAED4963EE407, k + 1)[j + 1]
        good = owner[:m] == owner[k - 1 :]
        out, who = mix(out[good]), owner[:m][good]
    count = np.diff(before)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([_whole(h[before[i] : before[i + 1]], k) for i in short], dtype=np.uint64)
        out, who = np.concatenate([out, extra]), np.concatenate([who, short])
        order = np.argsort(who, kind="stable")
        out, who = out[order], who[order]
    return out, who


def _whole(h: np.ndarray, k: int) -> np.uint64:
    x = (h * _power(0xA24BAED4963EE407, k + 1)[1 : len(h) + 1]).sum(dtype=np.uint64)
    return mix(np.array([x + np.uint64(len(h))], dtype=np.uint64))[0]


def sets(out: np.ndarray, who: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where each text's begin (one more entry than texts)."""
    edges = np.searchsorted(who, np.arange(texts + 1))
    parts, bounds = [], np.zeros(texts + 1, dtype=np.int64)
    for i in range(texts):
        x = np.unique(out[edges[i] : edges[i + 1]])
        parts.append(x)
        bounds[i + 1] = bounds[i] + len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), bounds


def column(values: np.ndarray) -> pa.Array:
    """An unsigned 64-bit array as Arrow int64, bit for bit."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values)
