"""The steps, from lines and candidate texts to a checked translation."""

import time

from pyspark.sql import functions as F

from foliant import api
from foliant.operators import layout, paragraphs, regions
from foliant.shared import cut
from foliant.sources import containers, extractors

from .test_operators import LINE, two_columns


def pages_of(spark):
    return spark.createDataFrame([(1, p, 530.0, 800.0) for p in range(3)], "doc_id long, pno int, width double, height double")


def test_postprocess(spark):
    lines = spark.createDataFrame(two_columns(), LINE)
    units = layout.ordered_lines(lines, pages_of(spark)).select("doc_id", F.col("seq").alias("idx"), "text")
    extra = spark.createDataFrame([(1, 1000, "![a](b.png)"), (1, 1001, "all use subject to JSTOR"), (1, 1002, "= a (2)")], "doc_id long, idx int, text string")
    planned = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0, "equation", None, "cation among", "![](e.png)"), (1, 1, 0.0, 0.0, 1.0, 1.0, "figure", "No such caption here", None, "![](f.png)")], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double, kind string, cap_text string, anchor string, link string")
    done = api.postprocess(units.unionByName(extra), lines, pages_of(spark), planned)
    texts = [r["text"] for r in done.blocks.orderBy("idx").collect()]
    body = " ".join(texts)
    assert "communi-" not in body and "b.png" not in body and "JSTOR" not in body and "= a (2)" not in body
    assert sum(t.startswith("> **각주") for t in texts) >= 2 and texts[-1] == "![](f.png)" and "![](e.png)" in texts
    assert done.dropped.first()["dropped"] > 0


def test_regions_are_planned_and_none_is_lost(spark):
    lines = spark.createDataFrame(two_columns(), LINE)
    units = layout.ordered_lines(lines, pages_of(spark)).select("doc_id", F.col("seq").alias("idx"), "text")
    table = spark.createDataFrame([(1, 1, 40.0, 95.0, 200.0, 130.0)], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double")
    shown = spark.createDataFrame([(1, 0, 7, 50.0, 300.0, 250.0, 500.0), (1, 2, 8, 50.0, 300.0, 250.0, 500.0)], "doc_id long, pno int, xref int, x0 double, y0 double, x1 double, y1 double")
    done = api.postprocess(units, lines, pages_of(spark), tables=table, images=shown)
    texts = [r["text"] for r in done.blocks.orderBy("idx").collect()]
    assert {"![](images/fig-p002-01.png)", "![](images/doc-p001-01.png)", "![](images/doc-p003-01.png)"} <= set(texts)
    assert not any("sbction" in t for t in texts) and any("left one" in t.replace("onae", "one") or "leaft" in t for t in texts)
    cover = spark.createDataFrame([(1, -1, "all use subject to JSTOR")], "doc_id long, idx int, text string")
    covered = api.postprocess(units.unionByName(cover), lines, pages_of(spark), tables=table, images=shown)
    links = {r["text"] for r in covered.blocks.collect()}
    assert "![](images/doc-p001-01.png)" not in links and "![](images/doc-p003-01.png)" in links


def test_equation_images(spark):
    planned = spark.createDataFrame([(1, 0, 0.0, 5.0, 1.0, 1.0, 5.0, "equation", "so that", "E"), (1, 0, 0.0, 1.0, 1.0, 1.0, 1.0, "table", None, "T")], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double, y double, kind string, anchor string, link string")
    texts = spark.createDataFrame([(1, "One so that\n\nanother"), (2, "plain\n\n\n\nstays")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in api.add_equation_images(texts, planned).collect()} == {1: "One so that\n\nE\n\nanother", 2: "plain\n\n\n\nstays"}


def test_extract_to_final(spark, tmp_path):
    long = "This is a paragraph of the paper which is long enough to be judged, and it ends as it should do."
    text = f"# Title\n\n{long}\n\n## Part\n\nIn 1993 (Berryman, 1983) it was.\n\n{long}"
    raw = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    candidates = spark.createDataFrame([(1, 0, "a", text[:60]), (1, 1, "b", text), (2, 0, "a", text[:90])], "doc_id long, ord int, name string, text string")
    got = {r["doc_id"]: r for r in api.extract(candidates, raw).collect()}
    assert got[1]["name"] == "b" and got[1]["gate_ok"] and not got[2]["gate_ok"]
    old = spark.createDataFrame([(1, 0, "old", text), (2, 0, "old", text)], "doc_id long, ord int, name string, text string")
    chosen = api.extract(candidates, raw, fallback=old)
    assert {r["doc_id"]: r["name"] for r in chosen.collect()} == {1: "b", 2: "old"}
    assert api.meta(chosen).where("doc_id = 1").first()["coverage"] == 1.0
    chunks = api.chunk(chosen, 120)
    assert chunks.count() > 2
    good = chunks.select("doc_id", "id", F.regexp_replace("text", "[A-Za-z]{5,}", "가나다라마바사").alias("text"))
    verdicts = api.verify(chunks, good.where("doc_id = 1")).collect()
    assert all(r["problems"] == ["no translation"] for r in verdicts if r["doc_id"] == 2)
    merged = api.assemble(chunks, good, spark.createDataFrame([(1, "용어")], "doc_id long, glossary string"))
    one = merged.where("doc_id = 1").first()
    assert one["complete"] and one["text"].endswith("## 용어 대응표 (Glossary)\n\n용어\n\n")
    assert api.render_html(merged).count() == 2
    assert api.write(chosen, chunks, merged, str(tmp_path / "made")) == 1
    held = {(r["kind"], r["doc_id"]): r["content"] for r in containers.read_documents(spark, str(tmp_path / "made")).where("kind <> 'chunk'").collect()}
    assert {k for k, _ in held} == {"source", "meta", "index", "merged"} and '"extractor"' in held["meta", 1] and held["source", 1].startswith("# Title")


def test_extractors_tell_failures(spark):
    def convert(raw):
        if raw == b"slow":
            time.sleep(20)
        if raw == b"none":
            return None
        return raw.decode()

    extractors.register("slow", convert)
    rows = [(1, bytearray(b"slow")), (2, bytearray(b"# A")), (3, None), (4, bytearray(b"none")), (5, bytearray(b"\xff")), (6, bytearray(b"")), (6, bytearray(b"again"))]
    files = spark.createDataFrame(rows, "doc_id long, content binary").withColumn("error", F.lit("clash"))
    tried = extractors.attempts(files, "slow", 2, seconds=0.5).collect()
    got = sorted((r["doc_id"], r["text"], (r["error"] or "").split(":")[0]) for r in tried if r["doc_id"] != 6)
    assert got == [(1, None, "Late"), (2, "# A", ""), (3, None, "no content"), (4, None, "no text"), (5, None, "UnicodeDecodeError")]
    assert sorted(r["text"] for r in tried if r["doc_id"] == 6) == ["", "again"] and {(r["ord"], r["name"]) for r in tried} == {(2, "slow")}
    told = {r["error"].split(":")[0]: (r["n"], r["files"]) for r in extractors.failures(extractors.attempts(files, "slow", seconds=0.5)).collect()}
    assert told == {k: (1, 7) for k in ("Late", "no content", "no text", "UnicodeDecodeError")}
    assert extractors.attempts(files.limit(0), "slow").count() == 0


def test_extractors_may_fail(spark):
    def convert(raw):
        if raw == b"bad":
            raise ValueError("broken file")
        return raw.decode()

    extractors.register("plain", convert)
    extractors.register("other", convert, needs="no_such_module")
    files = spark.createDataFrame([(1, bytearray(b"# A")), (2, bytearray(b"bad"))], "doc_id long, content binary")
    assert [(r["doc_id"], r["text"]) for r in extractors.run(files, "plain").collect()] == [(1, "# A")]
    assert extractors.available("plain") and not extractors.available("other")
    links = spark.createDataFrame([("![x](a/images/f.png) ![](q/r.png)",)], "t string").select(extractors.rewrite_image_links(F.col("t"))).first()[0]
    assert links == "![](images/f.png) ![](images/r.png)"


def test_candidates_at_once_are_as_each_by_itself(spark):
    lines = spark.createDataFrame(two_columns() + [(2, *r[1:]) for r in two_columns()], LINE)
    pages = pages_of(spark).unionByName(pages_of(spark).withColumn("doc_id", F.lit(2).cast("long")))
    table = spark.createDataFrame([(1, 1, 40.0, 95.0, 200.0, 130.0)], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double")
    shown = spark.createDataFrame([(d, p, 7 + p, 50.0, 300.0, 250.0, 500.0) for d in (1, 2) for p in (0, 2)], "doc_id long, pno int, xref int, x0 double, y0 double, x1 double, y1 double")
    seq = layout.ordered_lines(lines, pages).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n\n")
    whole = seq.select("doc_id", text.alias("text"))
    given = whole.select("doc_id", F.lit(0).alias("ord"), F.lit("a").alias("name"), "text").unionByName(
        whole.where("doc_id = 1").select("doc_id", F.lit(1).alias("ord"), F.lit("b").alias("name"), F.concat(F.lit("all use subject to JSTOR\n\n= a (2)\n\n"), F.col("text")).alias("text"))
    )
    planned = cut(regions.plan(lines, pages, table), "planned")
    made, dropped = api.postprocess_candidates(given, lines, pages, planned=planned, images=shown)
    got = {(r["doc_id"], r["ord"]): r["text"] for r in made.collect()}
    gone = {(r["doc_id"], r["ord"]): r["dropped"] for r in dropped.collect()}
    for k in (0, 1):
        alone = api.postprocess(paragraphs.explode_units(given.where(F.col("ord") == k)), lines, pages, planned=planned, images=shown)
        want = {r["doc_id"]: r["text"] for r in paragraphs.assemble_text(alone.blocks).collect()}
        assert {d: t for (d, o), t in got.items() if o == k} == {d: t for d, t in want.items() if (d, k) in got}
        assert {d: n for (d, o), n in gone.items() if o == k} == {r["doc_id"]: r["dropped"] for r in alone.dropped.collect() if (r["doc_id"], k) in gone}
    assert set(got) == {(1, 0), (2, 0), (1, 1)} and gone[1, 1] > gone[1, 0] and "doc-p001-01" in got[1, 0] and "doc-p001-01" not in got[1, 1]


def test_older_extraction(spark):
    long = "This paragraph is long enough to be taken for one that was broken by the end of its page, and so it goes on and"
    texts = spark.createDataFrame([(1, f"Head 1\n\n{long}\n\nHead 2\n\non the next page it ends, as the rule for the older way to mend pages says it should.\n\nHead 3\n\n12")], "doc_id long, text string")
    made, dropped = api.stitched(texts)
    assert made.first()["text"].startswith(long + " on the next") and dropped.first()["dropped"] == 3 * 5 + 2
