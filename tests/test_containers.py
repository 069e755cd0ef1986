"""Containers of many documents: commits, failures in the middle, versions."""

import pytest
from pyspark.sql import functions as F

from foliant.sources import containers

ROW = "doc_id long, kind string, name string, content string"


def rows(df):
    return {(r["doc_id"], r["kind"], r["name"]): r["content"] for r in df.collect()}


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "c")
    first = {(k, "source", ""): f"text {k}" for k in range(200)} | {(None, "source", None): "x", (1, "chunk", "001"): None}
    table = spark.createDataFrame([(*k, v) for k, v in first.items()], ROW)
    assert containers.write_documents(table, at, container=500) == 1
    assert rows(containers.read_documents(spark, at)) == first
    files = [p for p in (tmp_path / "c" / "data").rglob("*.parquet")]
    assert 1 < len(files) <= 1 + sum(len(v or "") for v in first.values()) // 500
    boom = F.when(F.col("doc_id") == 150, F.raise_error(F.lit("executor lost"))).otherwise(F.concat(F.lit("new "), F.col("content")))
    with pytest.raises(Exception, match="executor lost"):
        containers.write_documents(table.where("doc_id >= 100").withColumn("content", boom), at)
    assert containers.versions(spark, at) == [1] and rows(containers.read_documents(spark, at)) == first
    changed = table.where("doc_id >= 100").withColumn("content", F.concat(F.lit("new "), F.col("content")))
    assert containers.write_documents(changed, at) == 2
    want = {k: f"new {v}" if k[0] is not None and k[0] >= 100 else v for k, v in first.items()}
    assert rows(containers.read_documents(spark, at)) == want and rows(containers.read_documents(spark, at, 1)) == first
    assert containers.compact(spark, at) == 3 and rows(containers.read_documents(spark, at)) == want
    assert containers.sweep(spark, at) and containers.versions(spark, at) == [3] and rows(containers.read_documents(spark, at)) == want
    assert len(list((tmp_path / "c" / "data").iterdir())) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "c")
    table = spark.createDataFrame([(1, "a", "", "x")], ROW)
    containers.write_documents(table, at)
    seen = containers.versions(spark, at)
    containers.write_documents(table, at)
    monkeypatch.setattr(containers, "versions", lambda *_: seen)
    with pytest.raises(RuntimeError, match="write again"):
        containers.write_documents(table, at)


def test_empty_table(spark, tmp_path):
    at = str(tmp_path / "c")
    containers.write_documents(spark.createDataFrame([], ROW), at)
    assert containers.read_documents(spark, at).count() == 0
    with pytest.raises(ValueError, match="no version"):
        containers.read_documents(spark, at, 7)
