"""The span source: ranges of pages, columns, filters, commits, and the stream."""

import pytest
from pyspark.sql import functions as F

from foliant.sources import spans


def pages(spark, docs, per=10):
    rows = [(d, p, 530.0, 800.0, [(1.0 * k, 2.0, 3.0, 4.0, 8.0, "Roman", f"d{d} p{p} s{k} \u2028é\n") for k in range(3)] if p else None) for d in docs for p in range(per)]
    return spark.createDataFrame(rows, spans.PAGE)


def test_a_filter_reads_fewer_partitions(spark, tmp_path):
    at = str(tmp_path / "dump")
    spans.write_dump(pages(spark, range(8)), at, block=5)
    whole = spans.read_spans(spark, at)
    assert whole.count() == 8 * 9 * 3 and whole.where("text like '%é\n'").count() == 216
    ranged = spans.read_spans(spark, at, "pno int, text string", doc_id_from=3, doc_id_to=3, pno_to=4)
    assert ranged.columns == ["pno", "text"] and ranged.count() == 4 * 3
    assert whole.rdd.getNumPartitions() >= 16
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spans.read_spans(spark, at, "doc_id long, pno int, span_no int").where("doc_id = 3 AND pno <= 4")
        assert pushed.rdd.getNumPartitions() <= 2 and sorted((r["pno"], r["span_no"]) for r in pushed.collect()) == [(p, k) for p in range(1, 5) for k in range(3)]
        assert spans.read_spans(spark, at).where(F.col("doc_id").isin(1, 2) & (F.col("pno") > 7)).count() == 2 * 2 * 3
        assert spans.read_spans(spark, at).where("doc_id = 99").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_ranges_by_option(spark, tmp_path):
    at = str(tmp_path / "dump")
    spans.write_dump(pages(spark, range(8)), at, block=5)
    some = spans.read_spans(spark, at, doc_id_from=2, doc_id_to=3, pno_from=8)
    assert some.rdd.getNumPartitions() <= 4 and some.count() == 2 * 2 * 3


def test_what_no_list_names_is_not_read(spark, tmp_path):
    at = tmp_path / "dump"
    spans.write_dump(pages(spark, [1]), str(at))
    (at / "pages-lost.jsonl").write_text('{"doc_id": 9, "pno": 0, "width": 1, "height": 1, "spans": []}\n')
    with pytest.raises(Exception, match="a page has a number"):
        spans.write_dump(pages(spark, [2]).withColumn("pno", F.when(F.col("pno") < 5, F.col("pno"))), str(at))
    assert {r["doc_id"] for r in spans.read_spans(spark, str(at)).collect()} == {1} and len(spans.lists(str(at))) == 1


def test_stream_reads_each_commit_once(spark, tmp_path):
    at, out = str(tmp_path / "dump"), str(tmp_path / "out")
    for docs in ([1, 2], [3]):
        spans.write_dump(pages(spark, docs), at)
        rows = spans.stream_spans(spark, at, "doc_id long, pno int, text string")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(out).awaitTermination(120)
    assert {r["doc_id"]: r["count"] for r in spark.read.parquet(out).groupBy("doc_id").count().collect()} == {1: 27, 2: 27, 3: 27}


def test_empty_dump(spark, tmp_path):
    spans.write_dump(pages(spark, []), str(tmp_path / "dump"))
    assert spans.read_spans(spark, str(tmp_path / "dump")).count() == 0
