"""Sends this package to the executors, whose Python workers may not have it on their path, and bounds their memory."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()
#: What a worker holds from earlier tasks: each of these lets go of it.
CACHES: list[Callable[[], None]] = []
#: Bytes of an Arrow batch, where the session has Spark's own default.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Once an application: a zip of the package's modules, which Spark's own file server hands out."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    _SENT.add(context.applicationId)
    if context.getConf().get(BATCH[0]) is None:
        spark.conf.set(*BATCH)
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="foliant-code-")) / "foliant.zip"
    with zipfile.ZipFile(to, "w") as z:
        for module in sorted(root.rglob("*.py")):
            z.write(module, module.relative_to(root.parent))
    context.addPyFile(str(to.resolve()))


def trim() -> None:
    """Gives memory that is free in this worker back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def release() -> None:
    """Lets go of what earlier tasks left in this worker."""
    for clear in CACHES:
        clear()
    trim()


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema, keep: bool = False) -> DataFrame:
    """df.mapInArrow with this package on the workers' path. Unless told to keep them, a task first lets go of what other
    tasks left in its worker."""
    ship(df.sparkSession)

    def fresh(batches: Iterator) -> Iterator:
        if not keep:
            release()
        yield from run(batches)
        trim()

    return df.mapInArrow(fresh, schema)
