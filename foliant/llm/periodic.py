"""Periodic runs of words, found online: catchers over completed power-of-two blocks report squares, which merge into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WORD
from foliant.ship import map_arrow

#: Words of the first append; each further one is as long as all before it.
FIRST = 4096


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    h = (a ^ (b >> np.uint64(31)) ^ (b << np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ a) * np.uint64(0xBF58476D1CE4E5B9) + b
    return h ^ (h >> np.uint64(32))


def _names(words: list[bytes], seed: int) -> np.ndarray:
    named = map(hash, words) if not seed else (hash((seed, w)) for w in words)
    return np.fromiter(named, np.int64, len(words)).view(np.uint64)


class Catchers:
    """Squares of a text that grows by appended words.

    Level s has a catcher for each completed block of 2**s words, at multiples of 2**s. It compares its block with the
    words appended 2**(s+1) to 2**(s+2) - 1 words later (level 0: 1 to 3): the two words of a square of such a period are
    so long that the first holds a whole block. So each appended word advances two comparisons a level, by hashes of the
    2**s words that it completes, and a text of n words costs n log n. A block that comes again p words later is a piece
    of a square; the pieces of one period at consecutive blocks are one stretch. finish() extends stretches to both sides
    by halving steps and gives the runs. Their words are compared; where hashes were equal and words are not, all is
    found anew with other hashes.
    """

    def __init__(self, exponent: int = 4, length: int = 6, seed: int = 0):
        """exponent, length: of the runs that are asked for, at least."""
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.exponent, self.length, self.seed = exponent, length, seed
        self.words: list[bytes] = []
        self.hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.pieces: list[list[np.ndarray]] = [[]]

    def append(self, words: list[bytes]) -> None:
        before = len(self.words)
        self.words += words
        n = len(self.words)
        self.hashes[0] = np.concatenate([self.hashes[0], _names(words, self.seed)])
        level, start = 0, before  # start: the first position whose hash is new
        while True:
            b = 1 << level
            h = self.hashes[level]
            if len(h) > start:
                self._watch(level, start, h)
            if n < self.exponent * 4 * b or 2 * b > n:  # no run of the next level's periods fits in yet
                break
            if len(self.hashes) == level + 1:
                self.hashes.append(np.zeros(0, np.uint64))
                self.pieces.append([])
            held = len(self.hashes[level + 1])
            new = _mix(h[held : len(h) - b], h[held + b :])
            self.hashes[level + 1] = np.concatenate([self.hashes[level + 1], new])
            level, start = level + 1, held

    def _watch(self, level: int, start: int, h: np.ndarray) -> None:
        """The appended positions from start against the blocks that watch them."""
        b = 1 << level
        if level == 0:
            for p in (1, 2, 3):
                at = np.flatnonzero(h[max(start, p) :] == h[max(start, p) - p : len(h) - p]) + max(start, p)
                self._caught(level, at - p, at)
            return
        j = np.arange(max(start, 2 * b), len(h))
        k = (j - 2 * b) // b * b
        near = h[j] == h[k]
        self._caught(level, k[near], j[near])
        far = (k >= b) & (h[j] == h[np.maximum(k - b, 0)])
        self._caught(level, k[far] - b, j[far])

    def _caught(self, level: int, block: np.ndarray, at: np.ndarray) -> None:
        """Pieces become stretches (period, first block, last block), and those join what was caught before."""
        if len(block):
            k = block >> level
            self.pieces[level].append(np.stack([at - block, k, k]))
            if sum(x.shape[1] for x in self.pieces[level]) > 2 * FIRST:
                self.pieces[level] = [self._joined(level)]

    def _joined(self, level: int) -> np.ndarray:
        p, first, last = np.concatenate(self.pieces[level], axis=1)
        order = np.lexsort((first, p))
        p, first, last = p[order], first[order], last[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (first[1:] > last[:-1] + 1)])
        starts = np.flatnonzero(new)
        return np.stack([p[starts], first[starts], np.maximum.reduceat(last, starts)])

    def finish(self) -> np.ndarray:
        """The runs (start, length, period), by start, then period: the period is the smallest, no neighbouring word fits."""
        found = []
        n = len(self.words)
        for level, pieces in enumerate(self.pieces):
            if not pieces:
                continue
            b = 1 << level
            p, first, last = self._joined(level)
            fits = (last - first + 1) * b >= (self.exponent - 1) * p - 2 * (b - 1)
            p, left, right = p[fits], first[fits] * b, (last[fits] + 1) * b
            for t in range(level - 1, -1, -1):
                h, step = self.hashes[t], 1 << t
                at = np.maximum(left - step, 0)
                left = np.where((left >= step) & (h[at] == h[np.minimum(at + p, len(h) - 1)]), left - step, left)
                ends = right + p + step <= n
                at = np.where(ends, right, 0)
                right = np.where(ends & (h[at] == h[np.minimum(at + p, len(h) - 1)]), right + step, right)
            found.append(np.stack([left, right + p - left, p]))
        runs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        runs = self._smallest(runs).T
        w = self.words
        if all(w[a : a + n - p] == w[a + p : a + n] for a, n, p in runs.tolist()):
            return runs
        again = Catchers(self.exponent, self.length, self.seed + 1)
        again.append(w)
        return again.finish()

    def _smallest(self, runs: np.ndarray) -> np.ndarray:
        """Of runs of one place, which have periods that divide each other, the smallest period; those long enough."""
        runs = runs[:, (runs[1] >= self.length) & (runs[1] >= self.exponent * runs[2])]
        runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
        if runs.shape[1]:
            new = np.concatenate([[True], (np.diff(runs[0]) != 0) | (np.diff(runs[1]) != 0)])
            runs = runs[:, new]
        return runs[:, np.lexsort((runs[2], runs[0]))]


def runs_of(words: list[bytes], exponent: int = 4, length: int = 6) -> np.ndarray:
    """The runs of a text, its words appended in growing pieces."""
    if len(words) < max(length, exponent):
        return np.zeros((0, 3), np.int64)
    catchers, at, step = Catchers(exponent, length), 0, FIRST
    while at < len(words):
        catchers.append(words[at : at + step])
        at += step
        step = at
    return catchers.finish()


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _runs(exponent: int, length: int, key_type: pa.DataType):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # bytes are split at ASCII white space
                runs = runs_of(words, exponent, length)
                found.append([{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()])
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["key", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, exponent: int = 4, length: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key with runs, an array of (start, length, period) by start, then period, and collapsed, the words that no run
    holds after its first period, joined by single spaces.

    A run is a stretch of words with smallest period q, of at least exponent * q and length words, that no neighbouring
    word extends. Words are runs of anything but ASCII white space, numbered from 0. Null and empty texts have no runs and
    an empty text; repeated rows and null keys are rows of their own; texts may be of any length: one that is all one
    period costs n log n. An empty table gives no rows. Other columns are not read. Nothing is shuffled.
    """
    import pyspark.sql.pandas.types as types

    field = docs.select(F.col(key)).schema[0]
    kind = field.dataType.simpleString()
    out = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), _runs(exponent, length, types.to_arrow_type(field.dataType)), f"key {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.select(F.col("key").alias(key), "runs", "collapsed")


def looped(key: Column, text: Column) -> Column:
    """The text, of every tenth key by crc32 with its words from some place on repeated in a loop: cases to find."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def turned(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        part = lambda length: F.slice(words, (a + 1).cast("int"), length.cast("int"))
        whole = F.array_repeat(part(p), F.floor((n - a) / p).cast("int"))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.flatten(whole), part((n - a) % p)), " ")

    words = F.array(F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))  # of one array a lambda's words are made once
    return F.coalesce(F.get(F.transform(F.filter(words, lambda w: F.size(w) > 0), turned), F.lit(0)), text)
