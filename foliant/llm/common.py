"""Helpers shared by the operators: reading tables, cutting lineage, and distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.shared import cut, discard, scope, shared_dir

__all__ = ["WORD", "KEY_BITS", "bucket_count", "cut", "discard", "hash_key", "key_bucket", "prefix_sums", "scope", "shared_dir", "table"]

#: What the contracts call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash keys that records are ordered by.
KEY_BITS = 52


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_key(*cols: Column, salt: str = "") -> Column:
    """A non-negative key of KEY_BITS uniform bits, from md5, so that any SQL engine can give the same."""
    joined = F.concat_ws(":", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, KEY_BITS // 4), 16, 10).cast("long")


def key_bucket(key: Column, n: int) -> Column:
    """Which of n equal ranges of the key space holds the key. Rising with the key, so buckets in order are the keys in order."""
    return F.shiftright(F.shiftright(key, KEY_BITS - 30) * F.lit(n), 30)


def bucket_count(rows: int, per_bucket: int = 20_000) -> int:
    """So many ranges of the key space that a group of all rows has per_bucket rows in each; 64 at least."""
    return max(64, -(-rows // per_bucket))


def prefix_sums(df: DataFrame, groups: list[str], key: str, value: Column | None, out: str, n_buckets: int, ties: list[str]) -> DataFrame:
    """df with out: the sum of value (None: 1) over the rows of its group that come before it by (key, ties).

    Each group is dealt by ranges of the key, so that no group of any size meets in one task: sums of each range,
    their running sums over the ranges of a group (n_buckets rows of a group at most), then running sums inside a range.
    """
    v = F.lit(1).cast("long") if value is None else value
    df = df.withColumn("__bucket", key_bucket(F.col(key), n_buckets).cast("int")).withColumn("__value", v)
    over = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*groups, "__bucket").agg(F.sum("__value").alias("__sum"))
        .withColumn("__start", F.coalesce(F.sum("__sum").over(over), F.lit(0)).cast("long")).drop("__sum")
    )
    inside = Window.partitionBy(*groups, "__bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ran = df.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)).cast("long"))
    same = [ran[g].eqNullSafe(starts[g]) for g in groups]
    same.append(ran["__bucket"] == starts["__bucket"])
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = ran.join(starts, on, "inner").select(*[ran[c] for c in ran.columns], starts["__start"])
    return joined.withColumn(out, F.col("__start") + F.col("__inside")).drop("__bucket", "__value", "__inside", "__start")
