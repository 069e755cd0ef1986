"""Near-duplicate embeddings: PCA-ordered comparison of tiles that stops where cosine cannot reach the threshold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, discard
from foliant.llm.components import components
from foliant.llm.vectors import matrix, numbered, sound
from foliant.ship import map_arrow

#: Vectors of a tile.
TILE = 1024
#: Leading dimensions after which a tile's products are held against their bounds.
STEPS = (8, 16, 32)
#: Leading coordinates that tiles have boxes of.
LEADING = 8
#: What rounding may take from a bound.
SLACK = 1e-9


def principal(vectors: DataFrame, dim: int) -> np.ndarray:
    """Directions of falling second moment of the unit vectors, as columns. dim x dim sums come to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(np.float64)
            x /= np.linalg.norm(x, axis=1)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["k", "v"])

    found = map_arrow(vectors.select("embedding"), sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(dim * dim)
    for r in found:
        total[r["k"]] = r["v"]
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1])


def links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a (across: b) have a cosine of at least least. Products over leading principal dimensions come
    first; with the norms of what is left they bound the cosine, and pairs whose bound is too low go no further."""
    norms = [np.linalg.norm(x, axis=1) for x in (a, b)]
    p, q = (x @ axes / n[:, None] for x, n in zip((a, b), norms, strict=True))
    dim = a.shape[1]
    dots, done = np.zeros((len(p), len(q))), 0
    for step in (*[s for s in STEPS if s < dim], dim):
        dots += p[:, done:step] @ q[:, done:step].T
        done = step
        rest = (np.sqrt(np.maximum(0, (x[:, step:] ** 2).sum(1))) for x in (p, q))
        alive = dots + np.multiply.outer(*rest) >= least - SLACK
        if not alive.any():
            return alive
        rows, columns = alive.any(1), alive.any(0)
        if rows.sum() * columns.sum() < alive.size / 2:  # the comparison goes on without rows that have no pair left
            out = np.zeros(alive.shape, bool)
            out[np.ix_(rows, columns)] = _exact(a[rows], b[columns], norms[0][rows], norms[1][columns], alive[np.ix_(rows, columns)], least)
            return out
    return _exact(a, b, *norms, alive, least)


def _exact(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, alive: np.ndarray, least: float) -> np.ndarray:
    return alive & (a @ b.T / np.multiply.outer(na, nb) >= least)


def roots(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least place of each row's and column's component; columns count on from the rows, or are the rows."""
    n, m = linked.shape
    rows = np.arange(n)
    columns = rows if same else np.arange(n, n + m)
    far = n + m
    while True:
        to_rows = np.minimum(rows, np.where(linked, columns[None, :], far).min(1, initial=far))
        to_columns = np.minimum(columns, np.where(linked, to_rows[:, None], far).min(0, initial=far))
        if same:
            to_rows = to_columns = np.minimum(to_rows, to_columns)
        if (to_rows == rows).all() and (to_columns == columns).all():
            return rows, columns
        rows, columns = to_rows, to_columns


def near_vectors(embeddings: DataFrame, least: float = 0.98, key: str = "vec_id", label: str = "label", embedding: str = "embedding", tile: int = TILE) -> DataFrame:
    """For each row key, n_links, component_id and kept.

    Two vectors link when their labels are equal and not null, their lengths are equal, and their cosine, in double
    precision, is at least least. Vectors that are null, zero, hold null or non-finite components or have a null key link
    with nothing. component_id: the least key reached by links, or the own one; kept: the own one is it. Rows that share a
    key are one node: n_links counts their links together. An empty table gives no rows. Keys are whole numbers.

    Vectors of each length are compared apart; only the lengths that occur come to the driver. Tiles hold vectors of one
    label and one cell of a grid over the first two principal coordinates, in the order of the third. Unit vectors that
    link differ by sqrt(2 - 2 least) at most, the width of a cell, so only tiles of neighbouring cells meet, and of these
    only those whose boxes over the leading coordinates come so near. A meeting of two tiles gives one row a vector: how
    many links, and the least vector of the tiles that it reaches; never the pairs.
    """
    good = embeddings.where(sound(embedding) & F.col(label).isNotNull() & F.col(key).isNotNull())
    good = good.select(numbered(embeddings, key).alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    dim = F.size("embedding")
    found = good.groupBy(dim.alias("dim")).count().where(F.col("count") > 1).collect()
    met = [_met(good.where(dim == r["dim"]), r["dim"], least, tile) for r in found]
    plain = embeddings.select(key, F.col(key).cast("long").alias("__id"))
    if not met:
        return plain.select(key, F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))
    every = reduce(DataFrame.unionAll, met)
    counts = every.groupBy("id").agg(F.sum("n").alias("n_links"))
    found = components(every.select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = plain.join(counts, F.col("__id") == counts["id"], "left").drop("id").join(found, F.col("__id") == found["id"], "left").drop("id")
    component = F.coalesce("component", "__id")
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("__id")).alias("kept"))


def _met(vectors: DataFrame, dim: int, least: float, tile: int) -> DataFrame:
    """vectors of one length (id, label, embedding): id, n and root of each meeting of two tiles."""
    axes = principal(vectors, dim)
    reach = sqrt(max(0.0, 2 - 2 * least)) + SLACK
    leading = np.ascontiguousarray(axes[:, :LEADING])

    def coordinates(column: pa.Array) -> np.ndarray:
        x = matrix(column, dim)
        return x @ leading / np.linalg.norm(x, axis=1)[:, None]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = coordinates(batch.column(2))
            cells = np.zeros((len(c), 2), np.int32)
            cells[:, : min(2, dim)] = np.floor(c[:, :2] / reach)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(c[:, min(2, dim - 1)])], ["id", "label", "embedding", "x", "y", "lead"])

    kind = vectors.schema["label"].dataType.simpleString()
    placed = map_arrow(vectors, place, f"id long, label {kind}, embedding array<double>, x int, y int, lead double")
    order = ("label", "x", "y", "lead", "id")
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            c = coordinates(part.column("embedding"))
            one = [pa.array([number]), *[part.column(n).slice(0, 1).combine_chunks() for n in ("label", "x", "y")]]
            one = [v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in one]
            boxes = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (c.min(0), c.max(0))]
            data = [pa.array([v.tobytes()], pa.binary()) for v in (part.column("id").to_numpy().astype("<i8"), matrix(part.column("embedding"), dim).astype("<f8"))]
            return pa.RecordBatch.from_arrays([*one, *boxes, *data], ["tile", "label", "x", "y", "lo", "hi", "ids", "data"])

        def runs(rows: pa.Table) -> Iterator[tuple[int, int]]:
            """Ranges of one label and cell, tile rows at most."""
            codes = [rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy(), *[rows.column(n).to_numpy() for n in ("x", "y")]]
            new = np.any([np.diff(c) != 0 for c in codes], axis=0)
            start = 0
            for end in [*np.flatnonzero(new) + 1, rows.num_rows]:
                for a in range(start, end, tile):
                    yield a, min(a + tile, end)
                start = end

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * tile:
                rows = pa.Table.from_batches(held)
                *whole, (a, b) = runs(rows)
                for x, y in whole:
                    yield out(rows.slice(x, y - x))
                held = rows.slice(a, b - a).to_batches()
        if held and sum(b.num_rows for b in held):
            rows = pa.Table.from_batches(held)
            for x, y in runs(rows):
                yield out(rows.slice(x, y - x))

    tiled = cut(map_arrow(ordered, tiles, f"tile long, label {kind}, x int, y int, lo array<double>, hi array<double>, ids binary, data binary"), "tiles")
    meta = tiled.select("tile", "label", "x", "y", "lo", "hi")
    # Each pair of neighbouring cells once: a cell meets itself, and those after it.
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    left = meta.select("tile", "label", "x", "y", "lo", "hi", steps.alias("to"))
    left = left.select(F.col("tile").alias("tile_a"), "label", (F.col("x") + F.col("to.x")).alias("x"), (F.col("y") + F.col("to.y")).alias("y"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), ((F.col("to.x") == 0) & (F.col("to.y") == 0)).alias("own"))
    right = meta.withColumnsRenamed({"tile": "tile_b", "lo": "lo_b", "hi": "hi_b"})
    gaps = F.zip_with(F.arrays_zip("lo_a", "hi_a"), F.arrays_zip("lo_b", "hi_b"), lambda a, b: F.greatest(F.lit(0.0), b["lo_b"] - a["hi_a"], a["lo_a"] - b["hi_b"]))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= reach * reach
    meetings = left.join(right, ["label", "x", "y"]).where((~F.col("own") | (F.col("tile_a") <= F.col("tile_b"))) & near).select("tile_a", "tile_b")
    payload = tiled.select("tile", "ids", "data")
    pairs = meetings.join(payload.toDF("tile_a", "ids_a", "data_a"), "tile_a").join(payload.toDF("tile_b", "ids_b", "data_b"), "tile_b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["tile_a"] == row["tile_b"]
                ids = [np.frombuffer(row[f"ids_{s}"], "<i8") for s in "ab"]
                a, b = (np.frombuffer(row[f"data_{s}"], "<f8").reshape(-1, dim) for s in "ab")
                linked = links(a, b, axes, least)
                if same:
                    linked = linked | linked.T
                    np.fill_diagonal(linked, False)
                to_rows, to_columns = roots(linked, same)
                every = ids[0] if same else np.concatenate(ids)
                n = linked.sum(1) if same else np.concatenate([linked.sum(1), linked.sum(0)])
                root = to_rows if same else np.concatenate([to_rows, to_columns])
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(every[hit]), pa.array(n[hit].astype(np.int64)), pa.array(every[root[hit]])], ["id", "n", "root"])

    out = cut(map_arrow(pairs.repartition("tile_a", "tile_b"), meet, "id long, n long, root long"), "met")
    discard(tiled)
    return out
