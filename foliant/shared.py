"""Tables in the folder that driver and executors share: they cut lineage, and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where none is set, one is made if they are one
    process; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: The tables of cut() that each open scope answers for, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """The tables that cut() writes inside are deleted at the end, whatever happens: for work whose results are written
    before that. Tables of other work, before, beside or around it, stay."""
    tables: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), tables))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in tables:
            _delete(spark, path)


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read back: the lineage ends here, and a lost executor costs nothing that lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_written = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """df for a join by key over shuffles: it is not sent whole through the driver. For tables that grow with the input.
    Spark takes the size of a table's files for that of its rows, exploded ones too; a table that packs to a byte a row
    passes for small enough, and the driver then holds all of it."""
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of cut() that nothing reads any longer."""
    path = getattr(df, "path_written", None)
    if path:
        _delete(df.sparkSession, path)
        for tables in _SCOPES.get():
            if path in tables:
                tables.remove(path)
