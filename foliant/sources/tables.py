"""Readers, writers, and the views of the test tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T

LINE_SCHEMA = "doc_id string, pno int, line_no int, x0 double, x1 double, y0 double, y1 double, text string, size double, math double"
INDEX_SCHEMA = "array<struct<id:string,chars:int,images:array<string>,heading:string>>"
META_SCHEMA = "source string, type string, chars int, figures int, footnotes int, extractor string, coverage double, truncated double"
SUFFIXES = (".pdf", ".docx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Input documents of a folder: file, stem and mtime, by suffix. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("modificationTime").alias("mtime"))
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    kept = named.where(F.lower("file").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$"))
    return kept.select("file", T.work_stem(F.regexp_replace("file", r"\.[^.]*$", "")).alias("stem"), "mtime")


def count_files(spark: SparkSession, path: str, pattern: str = "*.md") -> int:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path").count()


def write_by_document(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy("doc_id").format(kind).save(path)


def write_texts(df: DataFrame, path: str, name: str = "id") -> None:
    """Texts as files of one folder for each document and name; a line end follows each."""
    df.select("doc_id", name, "text").write.mode("overwrite").partitionBy("doc_id", name).text(path)


def document_lines(docs: DataFrame) -> DataFrame:
    """The lines of documents, set on pages by a fixed rule: 40 a page, two columns, sizes and mathematics by place."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.selectExpr(
        "doc_id", "cast(i div 40 as int) AS pno", "i AS line_no",
        "48D + 237D * (i % 2) + CASE WHEN i % 5 = 0 THEN 8D ELSE 0D END AS x0",
        "80D + 17D * ((i % 40) div 2) AS y0", "trim(text) AS text",
        "CASE WHEN i % 11 = 3 THEN 6.5D WHEN i % 11 = 7 THEN 10.5D ELSE 8D END AS size",
        "CASE WHEN i % 17 = 0 THEN 0.8D ELSE 0D END AS math",
    ).selectExpr("doc_id", "pno", "line_no", "x0", "x0 + least(215D, 0.5D * size * length(text)) AS x1", "y0", "y0 + size AS y1", "text", "size", "math")


def pages_of(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "pno").distinct().withColumn("width", F.lit(530.0)).withColumn("height", F.lit(800.0))


def document_blocks(docs: DataFrame) -> DataFrame:
    """The lines of documents as blocks, some made headings, notes, pictures or formulas by place."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return lines.selectExpr(
        "doc_id", "idx",
        "CASE WHEN idx % 9 = 3 THEN concat('## ', text) WHEN idx % 9 = 5 THEN concat('> ', text) WHEN idx % 13 = 7 THEN '![](images/a.png)'"
        " WHEN idx % 11 = 6 THEN 'a = b + (3)' WHEN idx % 7 = 2 THEN concat(lower(substr(text, 1, 1)), substr(text, 2)) ELSE text END AS text",
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """A user's turn as source, the assistant's next one as its translation."""
    a = conversations.where(F.col("role") == "user").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.col("text").alias("source"))
    b = conversations.where(F.col("role") == "assistant").select(F.col("conv_id").alias("doc_id"), (F.col("turn") - 1).alias("id"), F.col("text").alias("translation"))
    return a.join(b, ["doc_id", "id"])
