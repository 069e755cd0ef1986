"""Documents' artefacts in containers: files of many documents, a manifest of what counts, and a commit that is one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts in a container, about.
CONTAINER = 256 << 20
KEY = ["doc_id", "kind", "name"]


class _Store:
    """A folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, target: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.at = self.path(target)
        self.fs = self.at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.io = spark._jvm.org.apache.commons.io.IOUtils
        self.target = target.rstrip("/")

    def names(self, folder: str) -> list[str]:
        where = self.path(f"{self.target}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(f"{self.target}/{name}"))
        try:
            return json.loads(bytes(self.io.toByteArray(stream)).decode())
        finally:
            stream.close()

    def put(self, name: str, value: dict) -> bool:
        """Whether the value is there now under a name that was free: it is written aside and renamed."""
        aside, final = self.path(f"{self.target}/aside/{uuid.uuid4().hex}"), self.path(f"{self.target}/{name}")
        self.fs.mkdirs(final.getParent())
        stream = self.fs.create(aside)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        return not self.fs.exists(final) and self.fs.rename(aside, final)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.target}/{name}"), True)


def versions(spark: SparkSession, target: str) -> list[int]:
    return [int(n.split(".")[0]) for n in _Store(spark, target).names("manifests")]


def write_documents(artefacts: DataFrame, target: str, container: int = CONTAINER) -> int:
    """Adds artefacts (doc_id, kind, name, content) to the containers of target, those of equal doc_id, kind and name in place
    of earlier ones, and gives the version that holds them.

    The rows are first written as a folder that no manifest names; then a manifest is renamed into place, after which
    all of them count. A write that fails leaves nothing to be read, however far it came. Files are as many as the bytes ask
    for, not as there are documents; a large document's artefacts lie in several. Two writers at once: the second fails,
    and may write again.
    """
    spark, store = artefacts.sparkSession, _Store(artefacts.sparkSession, target)
    last = max(versions(spark, target), default=0)
    held = store.read(f"manifests/{last:012d}.json")["folders"] if last else []
    folder = f"data/{uuid.uuid4().hex}"
    rows = artefacts.select(*KEY, "content")
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    files = max(1, -(-size // container))
    rows.repartition(files, *KEY).sortWithinPartitions(*KEY).write.parquet(f"{store.target}/{folder}")
    if not store.put(f"manifests/{last + 1:012d}.json", {"folders": [*held, folder], "files": files, "bytes": size}):
        raise RuntimeError(f"another writer made version {last + 1} of {target}; write again")
    return last + 1


def read_documents(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The artefacts of a version (the last one, if not said): doc_id, kind, name, content. Of several the latest counts."""
    found = versions(spark, target)
    version = max(found, default=0) if version is None else version
    if version not in found:
        raise ValueError(f"{target} has no version {version}")
    store = _Store(spark, target)
    folders = store.read(f"manifests/{version:012d}.json")["folders"]
    parts = [spark.read.parquet(f"{store.target}/{f}").withColumn("__at", F.lit(k)) for k, f in enumerate(folders)]
    if len(parts) == 1:
        return parts[0].drop("__at")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # Which rows are replaced is worked out on the keys; contents meet only the keys that have several.
    latest = rows.groupBy(*KEY).agg(F.max("__at").alias("last"), F.count("*").alias("n")).where(F.col("n") > 1)
    old = latest.select(*[F.col(c).alias(f"__{c}") for c in KEY], "last")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in KEY]
    return rows.join(old, on[0] & on[1] & on[2] & (F.col("__at") < F.col("last")), "left_anti").drop("__at")


def compact(spark: SparkSession, target: str, container: int = CONTAINER) -> int:
    """The last version as one folder: a new version of the same rows."""
    store, last = _Store(spark, target), max(versions(spark, target), default=0)
    rows, folder = read_documents(spark, target, last), f"data/{uuid.uuid4().hex}"
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    files = max(1, -(-size // container))
    rows.repartition(files, *KEY).sortWithinPartitions(*KEY).write.parquet(f"{store.target}/{folder}")
    if not store.put(f"manifests/{last + 1:012d}.json", {"folders": [folder], "files": files, "bytes": size}):
        raise RuntimeError(f"another writer made version {last + 1} of {target}; compact again")
    return last + 1


def sweep(spark: SparkSession, target: str, keep: int = 1) -> list[str]:
    """Deletes all but the last keep versions, and the folders that no version names: those of failed writes too, so none may
    be under way. Gives the folders' names."""
    store, found = _Store(spark, target), versions(spark, target)
    kept = {f for v in found[-keep:] for f in store.read(f"manifests/{v:012d}.json")["folders"]}
    gone = [f"data/{n}" for n in store.names("data") if f"data/{n}" not in kept]
    for v in found[:-keep]:
        store.delete(f"manifests/{v:012d}.json")
    for name in gone:
        store.delete(name)
    store.delete("aside")
    return gone
