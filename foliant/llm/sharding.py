"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import KEY_BITS, bucket_count, cut, hash_key, prefix_sums


def _score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), u uniform and drawn from key and shard alone; and the shard, smaller ones first."""
    u = (hash_key(key, F.lit(shard), salt="shard") + F.lit(0.5)) / F.lit(float(1 << KEY_BITS))
    return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Of the shards, from 0, the one with the best score for the key.

    A further shard changes no other's score, so records only move into it; a change of one weight moves records only
    from or to its shard. A weight of 0 closes a shard.
    """
    return (-_best(key, weights)["shard"]).cast("int")


def _best(key: Column, weights: Sequence[float]) -> Column:
    scores = [_score(key, k, w) for k, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("a shard must have a weight above 0")
    return scores[0] if len(scores) == 1 else F.array_max(F.array(*scores))


def shard(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """docs' key with shard, grown_shard (with one more shard), size, text_crc32 and slot.

    size: UTF-8 bytes of the text plus 16. slot: from 0 without gaps in each shard, by hash of the key. A null text
    counts as empty; null keys are one key; rows of equal key share a shard and have slots of their own; texts may be of
    any length. Other columns are not read. An empty table gives no rows. Texts are read once: what is made of them is
    written to the shared folder, and sums and slots are made from that.
    """
    weights = list(weights) if weights is not None else [1.0] * n_shards
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard")
    whole = F.coalesce(F.col(text), F.lit(""))
    best = docs.select(
        F.col(key), (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole.cast("binary")).cast("long").alias("text_crc32"),
        _best(F.col(key), weights).alias("__best"), _score(F.col(key), n_shards, 1.0).alias("__more"), hash_key(F.col(key), salt="slot").alias("__key"),
    )
    of = lambda c: (-c["shard"]).cast("int")
    made = best.select(key, "size", "text_crc32", "__key", of(F.col("__best")).alias("shard"), of(F.greatest("__best", "__more")).alias("grown_shard"))
    rows = cut(made, "shards")
    return prefix_sums(rows, ["shard"], "__key", None, "slot", bucket_count(rows.count()), [key, "text_crc32"]).drop("__key")
