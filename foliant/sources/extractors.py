"""Extractors that turn documents into candidate Markdown. Those of other programs plug in; what fails or takes too long is told."""

from __future__ import annotations

import importlib.util
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import html, layout
from foliant.ship import ship

#: name: (needed module or None, bytes to Markdown)
EXTRACTORS: dict[str, tuple[str | None, Callable[[bytes], str | None]]] = {}


def register(name: str, convert: Callable[[bytes], str | None], needs: str | None = None) -> None:
    EXTRACTORS[name] = (needs, convert)


def available(name: str) -> bool:
    needs = EXTRACTORS[name][0]
    return needs is None or importlib.util.find_spec(needs) is not None


class Late(Exception):
    """An extractor took longer than it may."""


@contextmanager
def _within(seconds: float | None) -> Iterator[None]:
    """Raises Late in what runs inside, once so many seconds have gone by; in a worker's main thread, as tasks run there."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_) -> None:
        raise Late(f"longer than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def attempts(files: DataFrame, name: str, ord: int = 0, seconds: float | None = None) -> DataFrame:
    """files (doc_id, content) through one extractor: doc_id, ord, name, text and error, a row for each file.

    error is null, or says why there is no text: the exception's kind and message, that the file took longer than seconds
    (none: any time), that the extractor gave nothing, or that there is no content.
    """
    ship(files.sparkSession)
    convert = EXTRACTORS[name][1]
    kind = files.schema["doc_id"].dataType.simpleString()

    def one(raw: bytes | None) -> tuple[str | None, str | None]:
        if raw is None:
            return None, "no content"
        try:
            with _within(seconds):
                text = convert(raw)
        except Exception as problem:  # noqa: BLE001  another program's failure is told, and ends no job
            return None, f"{type(problem).__name__}: {problem}"
        return text, "no text" if text is None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file's text by itself, so that no batch of texts is held
                text, error = one(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([text], pa.string()), pa.array([error], pa.string())], ["doc_id", "text", "error"])

    out = files.select("doc_id", F.col("content").cast("binary")).mapInArrow(work, f"doc_id {kind}, text string, error string")
    return out.select("doc_id", F.lit(ord).alias("ord"), F.lit(name).alias("name"), "text", "error")


def run(files: DataFrame, name: str, ord: int = 0, seconds: float | None = None) -> DataFrame:
    """The candidates of attempts: doc_id, ord, name and text; documents that the extractor fails on are left out."""
    return attempts(files, name, ord, seconds).where(F.col("error").isNull()).drop("error")


def failures(tried: DataFrame) -> DataFrame:
    """How often each extractor failed, of how many files, and why, from rows of attempts: name, error, n, files."""
    of = Window.partitionBy("name")
    counted = tried.groupBy("name", "error").agg(F.count("*").alias("n"))
    return counted.withColumn("files", F.sum("n").over(of)).where(F.col("error").isNotNull())


def by_columns(ordered: DataFrame, ord: int = 0) -> DataFrame:
    """The candidate of the reading order: one line a block."""
    return layout.raw_markdown(ordered).select("doc_id", F.lit(ord).alias("ord"), F.lit("columns").alias("name"), "text")


def by_html(pages: DataFrame, ord: int = 0) -> DataFrame:
    """The candidate of web pages (doc_id, html)."""
    parts = F.sort_array(F.collect_list(F.struct("idx", "text")))
    blocks = html.html_blocks(pages, key="doc_id").groupBy("doc_id").agg(parts.alias("p"))
    return blocks.select("doc_id", F.lit(ord).alias("ord"), F.lit("html").alias("name"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def rewrite_image_links(c):
    """Links of any folder to images/<file>."""
    once = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*?/?images/([^)]+)\)", "![](images/$1)")
    return F.regexp_replace(once, r"!\[[^\]]*\]\((?!images/)[^)]*?([^/)]+\.png)\)", "![](images/$1)")
