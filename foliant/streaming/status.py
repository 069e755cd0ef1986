"""Job status that survives restarts: keyed state over a stream of events, and a table of its upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.ship import ship
from foliant.streaming.files import process


def job_counts(events: DataFrame, kinds: Sequence[str], late: str = "1 hour", idle_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """Of a stream of events (id, stem, time, kind) the jobs that changed in each batch: stem, a count for each of kinds, total
    (of all kinds), last (the time of the latest event) and expired.

    An event that comes again within the time late counts once; one that is later than that behind the newest is left
    out. A job without events for idle_ms of event time is given out once more as expired, and its state is dropped: the
    state holds live jobs only, a few numbers each. A later event of its stem begins a new job. Null stems are one job.
    """
    ship(events.sparkSession)
    once = events.withWatermark("time", late).dropDuplicatesWithinWatermark(["id"])
    stem = events.schema["stem"].dataType.simpleString()
    names = [*kinds, "total"]
    counts = ", ".join(f"`{n}` long" for n in names)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [0] * len(names) + [0]
        if state.hasTimedOut:
            state.remove()
            yield _row(key[0], names, held, True)
            return
        for part in parts:
            seen = part["kind"].value_counts()
            for k, kind in enumerate(kinds):
                held[k] += int(seen.get(kind, 0))
            held[len(kinds)] += len(part)
            held[-1] = max(held[-1], int(part["time"].max().value // 1000))
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(held[-1] // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield _row(key[0], names, held, False)

    rows = once.groupBy("stem").applyInPandasWithState(update, f"stem {stem}, {counts}, last long, expired boolean", f"{counts}, last long", "update", GroupStateTimeout.EventTimeTimeout)
    return rows.withColumn("last", F.timestamp_micros("last"))


def _row(stem, names: Sequence[str], held: Sequence[int], expired: bool) -> pd.DataFrame:
    return pd.DataFrame({"stem": [stem], **{n: [v] for n, v in zip([*names, "last"], held, strict=True)}, "expired": [expired]})


def persist(counts: DataFrame, target: str, checkpoint: str, every: str | None = None):
    """Keeps the upserts of job_counts in target, a folder for each batch: one that runs again after a failure replaces what
    it wrote, so nothing counts twice. Without every: what is there, then it ends; the next call goes on from there."""
    return process(counts, lambda batch: batch, target, checkpoint, every, mode="update")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The latest row of each stem in the table that persist() keeps."""
    rows = spark.read.parquet(target)
    own = F.struct(*[c for c in rows.columns if c not in ("stem", "batch")])
    return rows.groupBy("stem").agg(F.max_by(own, "batch").alias("r")).select("stem", "r.*")


def compact(spark: SparkSession, target: str, to: str) -> None:
    """The table with one row a stem and no expired jobs, as batch -1 of another folder, which persist() may go on in."""
    current(spark, target).where(~F.col("expired")).write.mode("overwrite").parquet(f"{to}/batch=-1")
