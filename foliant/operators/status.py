"""Where each document's job stands, from what exists of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_status(jobs: DataFrame) -> DataFrame:
    """jobs (stem, html, running, known, source, indexed, chunks, translated, reviewed, glossary) with status, phase and pct.

    done needs the page and nothing running; a known job that ended without it has failed."""
    n = F.greatest(F.coalesce("chunks", F.lit(1)), F.lit(1))
    t, r = F.coalesce("translated", F.lit(0)), F.coalesce("reviewed", F.lit(0))
    of = lambda k: F.concat(F.lit(" ("), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))
    steps: list[tuple[Column, Column, Column]] = [
        (~F.col("source"), F.lit("extracting"), F.lit(4)),
        (~F.col("indexed"), F.lit("splitting"), F.lit(6)),
        (r > 0, F.concat(F.lit("reviewing"), of(r)), 70 + F.bround(25 * r / n)),
        (t >= n, F.lit("before review"), F.lit(70)),
        ((t > 0) | F.col("glossary"), F.concat(F.lit("translating"), of(t)), 25 + F.bround(45 * t / n)),
    ]
    phase, pct = F.lit("glossary"), F.lit(12)
    for test, name, value in reversed(steps):
        phase, pct = F.when(test, name).otherwise(phase), F.when(test, value).otherwise(pct)
    done = F.col("html") & ~F.col("running")
    status = F.when(done, "done").when(F.col("running"), "running").when(F.col("known"), "failed").otherwise("uploaded")
    phase = F.when(done, "complete").when(F.col("running"), phase).when(F.col("known"), "see the log").otherwise("waiting")
    pct = F.when(done, 100).when(F.col("running"), pct).otherwise(0)
    return jobs.select("stem", status.alias("status"), phase.alias("phase"), pct.cast("int").alias("pct"))


def job_list(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """All jobs: stems of inputs (stem, file, mtime; the first file by name counts) and of outputs (stem), newest first."""
    first = inputs.groupBy("stem").agg(F.min_by("file", "file").alias("file"), F.min_by("mtime", "file").alias("mtime"))
    return first.join(outputs.select("stem").distinct(), "stem", "full").orderBy(F.col("mtime").desc_nulls_last(), "stem")


def stale(page: Column, pdf: Column) -> Column:
    """Whether a printed file must be made anew."""
    return pdf.isNull() | (pdf < page)
