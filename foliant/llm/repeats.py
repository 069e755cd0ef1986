"""Passages that repeat across documents, by sparse suffix arrays over minimiser positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import cut, discard
from foliant.llm.kernels import U, buffers, grams, slices, stir, words
from foliant.llm.vectors import numbered
from foliant.ship import map_arrow

#: Suffixes of one gram that are sorted in one task; a gram that has more deals them to parts.
MANY = 20_000
#: Bytes that stand for a word beside a gram. Words must agree in all 40 bits, and the gram in 64.
CODE = 5


def _leftmost(x: np.ndarray, n: int) -> np.ndarray:
    """The place of the least of each n values in a row, the first of equal ones; len(x) - n + 1 of them."""
    place, done = np.arange(len(x)), 1
    while done < n:
        step = min(done, n - done)
        left = x[:-step] <= x[step:]
        x, place = np.where(left, x[:-step], x[step:]), np.where(left, place[:-step], place[step:])
        done += step
    return place


def minimisers(hashes: np.ndarray, at: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places whose gram has the least hash of some run of gram + window - 1 words inside a row of text, the first of
    equal ones; these hashes; and how many words such runs begin before the place, least and most. Equal runs have their
    place at equal distance, whatever stands around them."""
    span = gram + window - 1
    if len(hashes) < span:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    every = grams(hashes, gram, gram)
    place = _leftmost(every, window)
    run = np.arange(len(place))
    inside = run + span <= np.repeat(at[1:], np.diff(at))[: len(place)]
    place, run = place[inside], run[inside]
    chosen, first, n = np.unique(place, return_index=True, return_counts=True)  # places rise with the runs
    return chosen, every[chosen], chosen - run[first + n - 1], chosen - run[first]


def _sample(gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                hashes, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                place, h, _, _ = minimisers(hashes, at, gram, window)
                row = np.searchsorted(at, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[a:b][row])], ["h", "id"])

    return run


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _inner(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _suffixes(gram: int, window: int):
    """id, text, found (h and parts): the suffixes at the minimisers whose h is in found, as far as a run of the least
    length goes: codes of the words before the gram (nearest first), then of those behind it."""
    rest = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                hashes, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                place, h, near, far = minimisers(hashes, at, gram, window)
                found = batch.column(2).slice(a, b - a).flatten()
                if not len(place) or not len(found):
                    continue
                wanted, k = np.unique(found.field("h").to_numpy().view(np.uint64), return_index=True)
                parts = found.field("parts").to_numpy()[k]
                k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                some = np.flatnonzero(wanted[k] == h)
                place, h, near, far, parts = place[some], h[some], near[some], far[some], parts[k[some]]
                row = np.searchsorted(at, place, "right") - 1
                own = ids[a:b][row]
                dealt = stir(own.astype(np.uint64) * U(0x9E3779B97F4A7C15) + place.astype(np.uint64)) >> U(1)
                part = np.where(parts > 0, 1 + dealt.view(np.int64) % np.maximum(parts, 1), 0).astype(np.int32)
                sizes = far + rest - near
                step, p, left = _inner(sizes), np.repeat(place, sizes), np.repeat(far, sizes)
                source = np.where(step < left, p - 1 - step, p + gram + step - left)
                codes = hashes.view(np.uint8).reshape(-1, 8)[source, 8 - CODE :]
                columns = [h.view(np.int64), part, own, (place - at[row]).astype(np.int32), near.astype(np.int32), far.astype(np.int32)]
                blank = pa.nulls(len(place), pa.int64())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _binary(codes, sizes * CODE), blank, blank], [*_NAMES, "run", "other"])

    return run


_NAMES = ["key", "part", "id", "place", "near", "far", "codes"]


def _groups(work):
    """Rows sorted by key and part: work with all rows of whole groups; MANY bounds a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one group, whose others may still come
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held[-1:], batch])  # the last batch held shows whether its group goes on
            k, p = (rows.column(c).to_numpy() for c in (0, 1))
            other = np.flatnonzero((k != k[-1]) | (p != p[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            n = held[-1].num_rows if held else 0
            if last:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, last - n)]))
                held = []
            held.append(batch.slice(max(0, last - n)))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _sorted(text: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of rows of codes: their order by (before, codes), and how many codes each has in common with its
    neighbour before it there, -1 where before differs."""
    n, width, _ = text.shape
    heads = [np.ascontiguousarray(b).astype(">i8").view(np.uint8).reshape(n, 8) for b in before]
    order = np.argsort(np.ascontiguousarray(np.hstack([*heads, text.reshape(n, -1)])).view(f"V{8 * len(before) + width * CODE}").ravel(), kind="stable")
    common = np.full(n, -1)
    for a in range(0, n, 10_000):  # bounds the memory of the comparison
        one = text[order[a : a + 10_001]]
        same = (one[1:] == one[:-1]).all(2)
        common[a + 1 : a + len(one)] = np.where(same.all(1), width, same.argmin(1)) if width else 0
    for b in before:
        common[1:][b[order[1:]] != b[order[:-1]]] = -1
    return order, common


def _named(order: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """A number for each row: equal for those that have n codes in common, an interval of the suffix array."""
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(common < n)
    return name


def _matches(rows: pa.Table, rest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each number of words before the gram (at which a run of the least length begins): it, the rows that have such a
    run, the number of each one's group of equal runs, the groups' first members, and a hash of each run if parts need it.

    Rows are sorted by what stands behind the gram, and by what stands before it read backwards; neighbours are compared.
    Runs are equal whose rows share an interval of the first array that is long enough, and one of the second.
    """
    n = rows.num_rows
    key, part, near, far = (rows.column(c).to_numpy() for c in ("key", "part", "near", "far"))
    codes = rows.column("codes").combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    at = np.frombuffer(codes.buffers()[1], np.int32, n + 1, codes.offset * 4)
    flat = np.frombuffer(codes.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, CODE)
    sizes = np.diff(at) // CODE
    step, row = _inner(sizes), np.repeat(np.arange(n), sizes)
    back = step < far[row]
    left, right = np.zeros((n, rest, CODE), np.uint8), np.zeros((n, rest, CODE), np.uint8)
    left[row[back], step[back]] = flat[back]
    right[row[~back], (step - far[row])[~back]] = flat[~back]
    forward, backward = _sorted(right, key, part), _sorted(left)
    sums = [_sums(x, key) for x in (left, right)] if part.any() else None
    for k in range(rest + 1):
        some = np.flatnonzero((near <= k) & (k <= far))
        if not len(some):
            continue
        pair = (_named(*forward, rest - k) * (n + 1) + _named(*backward, k))[some]
        _, first, group = np.unique(pair, return_index=True, return_inverse=True)
        yield k, some, group, first, stir(sums[0][some, k] * U(0x9E3779B97F4A7C15) + sums[1][some, rest - k] + U(k)).view(np.int64) if sums else None


def _sums(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... codes of each row and its gram."""
    n, width, _ = text.shape
    whole = np.zeros((n, width, 8), np.uint8)
    whole[:, :, :CODE] = text
    powers = stir(np.arange(1, width + 1, dtype=np.uint64)) | U(1)
    each = stir(whole.view(np.uint64).reshape(n, width)) * powers
    return np.cumsum(np.hstack([stir(key.view(np.uint64))[:, None], each]), axis=1, dtype=np.uint64)


def _ends(rest: int):
    """For each key, part and run: the least and the greatest id that has it."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, ids = (rows.column(c).to_numpy() for c in ("key", "part", "id"))
        for _, some, group, first, run in _matches(rows, rest):
            lo, hi = _extremes(ids[some], group)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (key[some[first]], part[some[first]], lo, hi, run[first]))), ["key", "part", "lo", "hi", "run"])

    return work


def _extremes(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return np.minimum.reduceat(ids[order], starts), np.maximum.reduceat(ids[order], starts)


def _spans(least: int, rest: int):
    """The runs of least words that another id has too, those at places in a row as one span. Rows with a run are what
    the other parts of a gram have: its least id and, as other, its greatest."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        told = pc.is_valid(table.column("run"))
        rows, known = table.filter(pc.invert(told)), table.filter(told)
        if not rows.num_rows:
            return
        known_run, k = np.unique(known.column("run").to_numpy(), return_index=True)
        known_lo, known_hi = known.column("id").to_numpy()[k], known.column("other").to_numpy()[k]
        ids, place = rows.column("id").to_numpy(), rows.column("place").to_numpy()
        hit, earlier = np.zeros((len(ids), rest + 1), bool), np.zeros((len(ids), rest + 1), bool)
        for k, some, group, first, run in _matches(rows, rest):
            lo, hi = _extremes(ids[some], group)
            if len(known_run):
                at = np.minimum(np.searchsorted(known_run, run[first]), len(known_run) - 1)
                heard = known_run[at] == run[first]
                lo, hi = np.where(heard, np.minimum(lo, known_lo[at]), lo), np.where(heard, np.maximum(hi, known_hi[at]), hi)
            hit[some, rest - k] = (lo < hi)[group]
            earlier[some, rest - k] = lo[group] < ids[some]
        row, start = np.nonzero(hit)
        earlier = earlier[row, start]
        start += place[row] - rest
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))[: len(row)])
        last = np.append(first[1:], len(row))[: len(first)] - 1
        some = np.logical_or.reduceat(earlier, first) if len(first) else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row[first]]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + least).astype(np.int32)), pa.array(some)], ["id", "start", "stop", "earlier"])

    return work


def repeated_passages(docs: DataFrame, least: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of least words or more that stand in another document too: key, passage (from 0), start and n_words (in
    words of the whole text), and earlier (whether least words of it in a row stand in a document of smaller key).

    Words are compared A-Z as a-z. Overlapping passages are one. Texts that are null or shorter and rows of null key have
    none; rows that share a key are one document, so what repeats only among them does not count; an empty table gives no
    rows. least is 2 or more.

    A sparse suffix array: only suffixes at minimisers stay, places whose gram of about half the length has the least
    hash of some run of least words. Equal runs have theirs at one distance, so none is lost. Suffixes whose gram
    several documents have are sorted by content behind the gram, and by content before it, nearest word first;
    neighbours are compared in both orders, and matches extend left and right as far as common intervals of both go.
    A suffix holds the words that runs with its minimiser reach, so longer passages come from their overlapping spans.

    Where a gram occurs more than MANY times, its suffixes are dealt to parts, each with an array of its own. A part
    says which documents are the least and the greatest of each of its runs; what they are over all parts comes back to
    it as one more row a run, so that no task holds them all. Texts may be of any length.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    gram = least // 2
    rest = least - gram
    window = rest + 1
    rows = docs.where(F.col(key).isNotNull()).select(numbered(docs, key).alias("id"), F.col(text).alias("text"))
    sampled = cut(map_arrow(rows, _sample(gram, window), "h long, id long"), "minimisers")
    often = sampled.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where(F.col("lo") < F.col("hi"))
    often = often.select("h", F.when(F.col("n") > MANY, F.floor(F.col("n") / MANY) + 1).otherwise(0).cast("int").alias("parts"))
    often = cut(often, "often")  # as a table, so that the join below has no aggregate in it and adaptive execution may split a hot gram
    wanted = sampled.join(often, "h").groupBy("id").agg(F.collect_set(F.struct("h", "parts")).alias("found"))  # a document's own
    schema = "key long, part int, id long, place int, near int, far int, codes binary, run long, other long"
    suffixes = cut(map_arrow(rows.join(wanted, "id").select("id", "text", "found"), _suffixes(gram, window), schema), "suffixes")
    discard(sampled)

    sort = ("key", "part")
    hot = suffixes.where("part > 0").repartition(*sort).sortWithinPartitions(*sort)
    ends = cut(map_arrow(hot, _groups(_ends(rest)), "key long, part int, lo long, hi long, run long"), "run-ends")
    whole = ends.groupBy("key", "run").agg(F.min("lo").alias("id"), F.max("hi").alias("other")).where(F.col("id") < F.col("other"))
    known = ends.select("key", "part", "run").join(whole, ["key", "run"])
    dealt = suffixes.unionByName(known, allowMissingColumns=True).repartition(*sort).sortWithinPartitions(*sort)
    return _merged(map_arrow(dealt, _groups(_spans(least, rest)), "id long, start int, stop int, earlier boolean"), key)


def _merged(spans: DataFrame, key: str) -> DataFrame:
    spans = spans.groupBy("id", "start", "stop").agg(F.bool_or("earlier").alias("earlier"))
    order = Window.partitionBy("id").orderBy("start", "stop")
    reached: Column = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(0)))
    islands = islands.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    merged = islands.groupBy("id", "passage").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.bool_or("earlier").alias("earlier"))
    return merged.select(F.col("id").alias(key), "passage", "start", (F.col("stop") - F.col("start")).alias("n_words"), "earlier")
