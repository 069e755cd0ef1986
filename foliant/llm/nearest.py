"""Approximate nearest neighbours: a navigable small-world graph for each shard, results of the shards merged."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import cut
from foliant.llm.hnsw import Graph, Shape, build, level_sizes, search
from foliant.llm.vectors import by_length, matrix, numbered, sound
from foliant.ship import map_arrow

#: Bytes of a shard's vectors, on average, at most (16,384 vectors of 64 dimensions: README has the recall at that size);
#: and vectors of a shard where there are few shards, and these few.
SHARD_BYTES, FEW_ROWS, FEW_SHARDS = 8 << 20, 1000, 6
#: Queries that are searched with one copy of a shard, on average, at most; and at least, where there are few shards.
QUERIES, FEW_QUERIES = 1 << 20, 1000

INDEX = "shard int, dim int, sizes array<int>, vectors binary, members binary, first binary, levels array<binary>, widths array<int>, depth int"


def shard_count(rows: int, dim: int) -> int:
    return max(-(-rows * 8 * dim // SHARD_BYTES), min(FEW_SHARDS, -(-rows // FEW_ROWS)))


def _build(norms: dict[int, float], depth: int, shape: Shape):
    def graph_of(table: pa.Table) -> pa.RecordBatch:
        dim = table.column("dim")[0].as_py()
        norm = norms[dim]
        ids = table.column("id").to_numpy()
        x = matrix(table.column("embedding"), dim).astype(np.float64)
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        # Equal vectors are one node; of its ids a search for depth rows needs the depth + 1 smallest at most.
        head = np.append(True, (x[1:] != x[:-1]).any(1))
        group = np.cumsum(head) - 1
        again = np.append(False, (ids[1:] == ids[:-1]) & ~head[1:])
        group, ids_left = group[~again], ids[~again]
        starts = np.flatnonzero(np.append(True, np.diff(group) > 0))
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        group, members = group[rank <= depth], ids_left[rank <= depth]
        points, least = x[head], ids[head]
        order, sizes = level_sizes(least, shape.links)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[group], kind="stable")
        members, group = members[by], place[group][by]
        points = points[order]
        lifted = np.concatenate([points, np.sqrt(np.maximum(0, norm**2 - (points**2).sum(1)))[:, None]], 1).astype(np.float32)
        graph = build(lifted, sizes, shape)
        first = np.searchsorted(group, np.arange(len(points) + 1))
        row = [
            [table.column("shard")[0].as_py()], [dim], [sizes], [points.astype("<f8").tobytes()], [members.astype("<i8").tobytes()],
            [first.astype("<i8").tobytes()], [[x.astype("<i4").tobytes() for x in graph.levels]], [[x.shape[1] for x in graph.levels]], [depth],
        ]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["shard", "dim", "sizes", "vectors", "members", "first", "levels", "widths", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a partition is a shard
        if held:
            yield graph_of(pa.Table.from_batches(held))

    return run


def build_index(embeddings: DataFrame, depth: int = 20, key: str = "vec_id", embedding: str = "embedding", shape: Shape = Shape()) -> DataFrame:
    """A row for each shard: its distinct vectors, the ids of each, and each level's neighbours as flat arrays. Vectors of
    each length have shards of their own. Vectors that are null, zero, hold null or non-finite components or have a null
    id take no part. depth: how many results a search will ask for at most. Ids are whole numbers. An empty table gives
    no shards.

    Shards are dealt by a hash of the vector, so that equal vectors, however many, become one node. For inner products a
    coordinate is added that gives all vectors the norm of the longest of their length; then nearness is that of a metric.
    A count and a norm for each length come to the driver.
    """
    good = embeddings.where(sound(embedding) & F.col(key).isNotNull())
    rows = good.select(numbered(embeddings, key).alias("id"), F.col(embedding).cast("array<double>").alias("embedding")).withColumn("dim", F.size("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    found = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("most")).orderBy("dim").collect()
    shards = {r["dim"]: shard_count(r["n"], r["dim"]) for r in found} or {0: 1}
    starts = dict(zip(shards, [0, *accumulate(shards.values())], strict=False))
    dealt = rows.withColumn("shard", (by_length(starts) + F.pmod(F.xxhash64("embedding"), by_length(shards))).cast("int"))
    norms = {r["dim"]: float(r["most"]) ** 0.5 for r in found}
    return cut(map_arrow(dealt.repartitionById(sum(shards.values()), F.col("shard")), _build(norms, depth, shape), INDEX), "hnsw")


def _search(depth: int, width: int):
    def found(row: dict, asked: pa.RecordBatch) -> pa.RecordBatch:
        dim = row["dim"]
        points = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
        members, first = np.frombuffer(row["members"], "<i8"), np.frombuffer(row["first"], "<i8")
        ids, x = asked.column("query_id").to_numpy(), matrix(asked.column("embedding"), dim)
        out: list[list[np.ndarray]] = [[], [], []]
        for k in range(0, len(ids), 256):
            near = search(row["graph"], row["sizes"], x[k : k + 256].astype(np.float32), width)
            for query, vector, nodes in zip(ids[k : k + 256], x[k : k + 256], near, strict=True):
                nodes = nodes[nodes >= 0]
                if len(nodes) <= depth and len(nodes) < len(points):  # the graph led to fewer than were asked for: all are
                    nodes = np.arange(len(points))
                score = (points[nodes] * vector).sum(1)
                each = first[nodes + 1] - first[nodes]
                every = np.concatenate([members[first[v] : first[v + 1]] for v in nodes]) if len(nodes) else members[:0]
                score = np.repeat(score, each)
                other = every != query
                every, score = every[other], score[other]
                best = np.lexsort((every, -score))[:depth]
                for c, v in zip(out, (np.full(len(best), query), every[best], score[best]), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard its own row, then its queries."""
        row: dict = {}
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            edges = [0, *np.flatnonzero(np.diff(slots)) + 1, len(slots)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                if part.column("sizes")[0].is_valid:
                    row = part.slice(0, 1).to_pylist()[0]
                    levels = [np.frombuffer(v, "<i4").reshape(-1, w) for v, w in zip(row.pop("levels"), row["widths"], strict=True)]
                    row["graph"] = Graph(np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"]).astype(np.float32), levels)
                    part = part.slice(1)
                if len(part) and row.get("slot") == slots[a]:
                    yield found(row, part)

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, width: int = 256, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each query (key and embedding of queries) the k nearest found by largest inner product, the row of its own id
    left out: query_id, rank from 1, vec_id, score in double precision on the original vectors; ties to the smaller id.

    Every query is sent to every shard of its length, and a shard to QUERIES of its queries at once, which it meets as they
    stream by; a shard gives k rows a query, and they are merged. k may be at most the depth that the index was built for,
    and is refused above it; the list of a search is width, and longer where k is. A shard in which a search finds fewer
    than k is compared as a whole, so results are never short. Queries that are no sound vector, or whose length no
    shard has, have no results; rows of one query id count once, the least vector.
    """
    spark = index.sparkSession
    asked = queries.where(sound(embedding) & F.col(key).isNotNull()).groupBy(numbered(queries, key).alias("query_id")).agg(F.min(F.col(embedding).cast("array<double>")).alias("embedding"))
    asked = asked.withColumn("dim", F.size("embedding"))
    of_length = index.groupBy("dim").agg(F.min("shard").alias("first"), F.max("shard").alias("last"), F.min("depth").alias("depth")).collect()
    if k > min((r["depth"] for r in of_length), default=k):
        raise ValueError(f"the index was built for {min(r['depth'] for r in of_length)} results, not {k}")
    if not of_length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, n = max(r["last"] for r in of_length) + 1, asked.count()
    parts = max(1, -(-n // QUERIES), min(-(-n // FEW_QUERIES), -(-spark.sparkContext.defaultParallelism // shards)))
    slot = lambda shard, part: (shard * parts + part).cast("int").alias("slot")
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).select(slot(F.col("shard"), F.col("part")), *index.columns)
    span = F.sequence(by_length({r["dim"]: r["first"] for r in of_length}), by_length({r["dim"]: r["last"] for r in of_length}))
    sent = asked.where(F.col("dim").isin([r["dim"] for r in of_length])).select("query_id", "embedding", F.explode(span).alias("shard"))
    sent = sent.select(slot(F.col("shard"), F.pmod(F.xxhash64("query_id"), F.lit(parts))), "query_id", "embedding")
    both = copies.unionByName(sent, allowMissingColumns=True).repartitionById(shards * parts, F.col("slot"))
    found = map_arrow(both.sortWithinPartitions("slot", F.col("sizes").isNull()), _search(k, max(width, k + 1)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
