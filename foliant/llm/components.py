"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliant.llm.common import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead to smaller nodes; a node and its neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """edges as a table; and their number and a checksum, seen as it is written."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return out, seen.get


def components(edges: DataFrame) -> DataFrame:
    """id and component, the least id that it reaches, for all ids of edges (columns a and b) but components' least.

    Nulls and edges from a node to itself are left out. Every round is written to the shared folder; only a count and
    a checksum come to the driver. Rounds grow with the logarithm of a component's size.
    """
    kept = edges.where(F.col("a") != F.col("b"))
    now, seen = _written(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while seen["n"] and seen != before:
        before = seen
        stars = cut(_large_star(now), "stars")  # read three times below, which would be made anew each time
        after, seen = _written(_small_star(stars))
        discard(stars)
        discard(now)
        now = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
