"""Chunks of a document for translation: sections, hard splits, greedy packing, and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant import config as C
from foliant.functions import text as T

EMPTY = "cast(array() as array<struct<text:string,sealed:boolean>>)"


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """A section begins with each heading line; line ends stay with their lines."""
    lines = F.regexp_extract_all(F.col(text), F.lit(r"(?s)[^\n]*\n|[^\n]+$"), F.lit(0))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = docs.select("doc_id", F.posexplode(lines).alias("pos", "line"))
    rows = rows.withColumn("heads", F.sum(F.col("line").rlike(C.SECTION_LINE).cast("int")).over(order))
    first = F.when(F.min("heads").over(Window.partitionBy("doc_id")) == 1, F.lit(1)).otherwise(F.lit(0))
    gathered = rows.withColumn("idx", F.col("heads") - first).groupBy("doc_id", "idx").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return gathered.select("doc_id", "idx", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))


def hard_split(c: Column, most: int = C.CHUNK_CHARS) -> Column:
    """Parts of a section at blank lines, each as long as fits; a longer paragraph stays whole."""

    def step(a: Column, p: Column) -> Column:
        last = F.element_at(a, -1)
        fits = (F.size(a) > 0) & ((last == "") | (F.length(last) + F.length(p) + 2 <= most))
        glued = F.when(last == "", p).otherwise(F.concat(last, F.lit("\n\n"), p))
        return F.when(F.size(a) == 0, F.array(p)).when(fits, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(glued))).otherwise(F.concat(a, F.array(p)))

    return F.filter(F.aggregate(F.split(c, "\n\n"), F.array().cast("array<string>"), step), lambda x: x != "")


def packed(lengths: Column, most: int = C.CHUNK_CHARS) -> Column:
    """The number of the chunk of each atom, of an array of (length, sealed): an atom opens a chunk where it or the one
    before is sealed, or where the two would be too long."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("chunk"), F.lit(0).alias("total"), F.lit(True).alias("closed"))

    def step(s: Column, a: Column) -> Column:
        opens = (F.size(s["ids"]) > 0) & (a["sealed"] | s["closed"] | (s["total"] + a["length"] > most))
        chunk = s["chunk"] + opens.cast("int")
        total = F.when(opens, a["length"]).otherwise(s["total"] + a["length"])
        return F.struct(F.concat(s["ids"], F.array(chunk)).alias("ids"), chunk.alias("chunk"), total.alias("total"), a["sealed"].alias("closed"))

    return F.aggregate(lengths, start, step)["ids"]


def chunks(sections: DataFrame, most: int = C.CHUNK_CHARS) -> DataFrame:
    """Chunks (doc_id, id, text) of at most most characters, but for longer paragraphs: sections are packed in order; one
    that is too long is split and shares no chunk."""
    t = F.col("text")
    long = F.length(t) > most
    atoms = F.when(long, F.transform(hard_split(t, most), lambda p: F.struct(p.alias("text"), F.lit(True).alias("sealed")))).otherwise(F.array(F.struct(t.alias("text"), F.lit(False).alias("sealed"))))
    parts = sections.select("doc_id", "idx", F.posexplode(atoms).alias("k", "a"))
    lists = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "k", F.col("a.text").alias("text"), F.col("a.sealed").alias("sealed")))).alias("l"))
    numbered = lists.withColumn("ids", packed(F.transform("l", lambda x: F.struct(F.length(x["text"]).alias("length"), x["sealed"].alias("sealed"))), most))
    rows = numbered.select("doc_id", F.posexplode(F.arrays_zip("l", "ids")).alias("pos", "z"))
    gathered = rows.groupBy("doc_id", F.col("z.ids").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("z.l.text").alias("text")))).alias("l"))
    return gathered.select("doc_id", F.concat(F.lpad((F.col("chunk") + 1).cast("string"), 3, "0"), F.lit(".md")).alias("id"), F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"))


def chunk_index(chunked: DataFrame) -> DataFrame:
    """The entry of each chunk: id, characters, image links and first heading."""
    t = F.col("text")
    return chunked.select("doc_id", "id", F.length(t).alias("chars"), T.image_links(t).alias("images"), T.first_heading(t).alias("heading"))


def index_json(index: DataFrame) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("id", "chars", "images", "heading")))
    return index.groupBy("doc_id").agg(F.to_json(entries).alias("json"))
