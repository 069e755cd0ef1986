"""Documents that arrive as files: the batch operators over a stream whose unit is a whole document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 64, pattern: str | None = None) -> DataFrame:
    """A stream of the files of a folder."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def once_each(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Without documents that come again within a time; state is kept no longer."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, every: str | None = None, mode: str = "append"):
    """Runs work on each batch of documents and appends its rows to target, in a folder of the batch's own, so that a batch
    that runs again replaces what it wrote. Without every: what is there, then it ends."""

    def batch(docs: DataFrame, number: int) -> None:
        work(docs).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def status_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """How many events of each kind come in each window: the polled status, as a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
