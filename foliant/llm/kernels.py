"""Array code over the bytes of whole Arrow text columns: words, their hashes, and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SEED = np.random.default_rng(20240229)
#: A random odd number for each byte value, and powers of an odd number by place in a word.
_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        step = _POWERS[-1:] * U(0x9E3779B97F4A7C15)
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def stir(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a one-to-one map."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where its rows begin, and the end; null rows are empty."""
    column = (column if isinstance(column, pa.Array) else column.combine_chunks()).cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many bytes; a longer row is a run by itself."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z as a-z, in order; and where each row's words begin, and the end."""
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    places = np.flatnonzero(inside)
    if not len(places):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.flatnonzero(first)
    at = np.searchsorted(places, starts)
    sizes = np.diff(np.append(at, len(places)))
    inner = np.arange(len(places)) - np.repeat(at, sizes)
    part = _BYTE[_LOWER[data[places]]] * _powers(int(sizes.max()))[inner]
    return stir(np.add.reduceat(part, at) + sizes.astype(np.uint64)), np.searchsorted(starts, offsets).astype(np.int64)


def word_starts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of n words, at the place of its first; len(hashes) - n + 1 of them, over row ends too."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, U(2 * salt + 1))
    for k in range(n):
        out = out * U(0xD6E8FEB86659FD93) + hashes[k : k + m]
    return stir(out)
