"""Vectorised words and shingles of many texts at once, on the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than white space (0x20 and 0x09 to 0x0D). Words and shingles stand as 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE up to n, and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(n, CHUNK_BYTES + 1).bit_length()
        for i, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            all_ = np.full(size, base, np.uint64)
            all_[0] = 1
            _powers[i] = np.multiply.accumulate(all_)
    return _powers[0], _powers[1]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, row after the last, bytes, bounds) of successive rows: row i's bytes lie from bounds[i] to bounds[i + 1]. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def minima(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w successive values."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, word bounds): row i's words are those from word bounds[i] to word bounds[i + 1]."""
    n = len(data)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    at = edges[(edges > 0) & (edges < n)]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data] if lower else data).astype(np.uint64) * up[1 : n + 1], out=total[1:])
    hashed = (total[end] - total[start]) * down[start]
    return mix(hashed ^ ((end - start).astype(np.uint64) << np.uint64(40))), start, end, np.searchsorted(start, bounds)


def shingles(hashed: np.ndarray, word_bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether they lie in one row)."""
    n = len(hashed)
    out = hashed.copy()
    for i in range(1, k):
        out[: n - i] = mix(out[: n - i] * np.uint64(0x9FB21C651E98DF25) + hashed[i:]) if n > i else out[: n - i]
    left = np.repeat(word_bounds[1:], np.diff(word_bounds)) - np.arange(n)
    return out, left >= k
