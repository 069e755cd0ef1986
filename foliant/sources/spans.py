"""Page dumps as a data source: spans of text by page, read in ranges of pages, as a table or as a stream.

A dump is a folder of JSON lines, one a page: doc_id, pno, width, height and spans (x0, y0, x1, y1, size, font, text). Each
commit adds files and a list of their blocks: where one starts, its length, and the documents and pages in it. The list is
what counts: a file that none names is not read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from foliant.ship import ship

SCHEMA = "doc_id long, pno int, width double, height double, span_no int, x0 double, y0 double, x1 double, y1 double, size double, font string, text string"
PAGE = "doc_id long, pno int, width double, height double, spans array<struct<x0:double,y0:double,x1:double,y1:double,size:double,font:string,text:string>>"
SPAN = ("x0", "y0", "x1", "y1", "size", "font", "text")
#: Pages of a block, which is the least that is read.
BLOCK_PAGES = 256
#: Columns that blocks know the range of.
RANGES = ("doc_id", "pno")


def _store(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


@dataclass
class Block(InputPartition):
    """A run of pages in a file. least, most: of doc_id and pno."""

    file: str
    offset: int
    length: int
    least: tuple[int, int]
    most: tuple[int, int]


@dataclass
class Written(WriterCommitMessage):
    blocks: list[dict]


def lists(path: str) -> list[str]:
    """The names of the lists of a dump, in the order of their commits."""
    fs, at = _store(path)
    return sorted(f.base_name for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.type == FileType.File and f.base_name.startswith("blocks-"))


def blocks_of(path: str, names: list[str]) -> list[Block]:
    fs, at = _store(path)
    found = []
    for name in names:
        with fs.open_input_stream(f"{at}/{name}") as f:
            found += [Block(b["file"], b["offset"], b["length"], tuple(b["least"]), tuple(b["most"])) for b in json.loads(f.read())]
    return found


class _Pages:
    """What batch and stream readers share: the fields of each span that the schema asks for."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.fields = path, [(f.name, f.dataType.simpleString()) for f in schema]

    def rows(self, block: Block) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        fs, at = _store(self.path)
        with fs.open_input_file(f"{at}/{block.file}") as f:
            f.seek(block.offset)
            pages = [json.loads(line) for line in f.read(block.length).splitlines()]
        columns = []
        for name, kind in self.fields:
            if name in SPAN:
                k = SPAN.index(name)
                values = [s[k] for p in pages for s in p["spans"]]
            elif name == "span_no":
                values = [k for p in pages for k in range(len(p["spans"]))]
            else:
                values = [p[name] for p in pages for _ in p["spans"]]
            columns.append(pa.array(values, kinds[kind]))
        yield pa.RecordBatch.from_arrays(columns, [n for n, _ in self.fields])


class Reader(_Pages, DataSourceReader):
    """Ranges of doc_id and pno that the options name (doc_id_from, pno_to, ...) choose the blocks that are read."""

    def __init__(self, path: str, schema: StructType, options: dict):
        super().__init__(path, schema)
        self.least = [int(options[f"{c}_from"]) if f"{c}_from" in options else None for c in RANGES]
        self.most = [int(options[f"{c}_to"]) if f"{c}_to" in options else None for c in RANGES]

    def partitions(self) -> list[Block]:
        keep = lambda b: all((lo is None or b.most[k] >= lo) and (hi is None or b.least[k] <= hi) for k, (lo, hi) in enumerate(zip(self.least, self.most, strict=True)))
        return [b for b in blocks_of(self.path, lists(self.path)) if keep(b)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Block):  # without blocks there is one empty partition
            yield from self.rows(partition)


class PushedReader(Reader):
    """Also takes what a query asks of doc_id and pno. All filters are left to Spark too, since a block holds several pages."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in RANGES:
                k = RANGES.index(name)
                lo = f.value if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else min(f.value) if isinstance(f, In) and f.value else None
                hi = f.value if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else max(f.value) if isinstance(f, In) and f.value else None
                self.least[k] = lo if self.least[k] is None else self.least[k] if lo is None else max(lo, self.least[k])
                self.most[k] = hi if self.most[k] is None else self.most[k] if hi is None else min(hi, self.most[k])
            yield f


class StreamReader(_Pages, DataSourceStreamReader):
    """The blocks of each commit, as it comes."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(lists(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        return blocks_of(self.path, [n for n in lists(self.path) if start["after"] < n <= end["after"]])

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class Writer(DataSourceArrowWriter):
    """A file for each task, and at the end the list of all blocks under a name that later ones follow. A task or a job that
    fails leaves files that no list names."""

    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _store(self.path)
        name, blocks, offset, held, keys = f"pages-{uuid.uuid4().hex}.jsonl", [], 0, [], []

        def block() -> None:
            nonlocal offset
            data = "".join(held).encode()
            out.write(data)
            blocks.append({"file": name, "offset": offset, "length": len(data), "least": [min(c) for c in zip(*keys, strict=True)], "most": [max(c) for c in zip(*keys, strict=True)]})
            offset += len(data)
            held.clear()
            keys.clear()

        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    row["spans"] = [[s[c] for c in SPAN] for s in row["spans"] or ()]
                    held.append(json.dumps(row, ensure_ascii=False) + "\n")
                    keys.append((row["doc_id"], row["pno"]))
                    if len(held) == self.pages:
                        block()
            if held:
                block()
        return Written(blocks)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _store(self.path)
        blocks = [b for m in messages if m for b in m.blocks]
        fs.create_dir(at, recursive=True)
        aside = f"{at}/aside-{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps(blocks).encode())
        fs.move(aside, f"{at}/blocks-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _store(self.path)
        for name in {b["file"] for m in messages if m for b in m.blocks}:
            fs.delete_file(f"{at}/{name}")


class SpanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spans"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        kind = PushedReader if options.get("pushdown") == "true" else Reader
        return kind(options["path"], schema, options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], int(self.options.get("pages", BLOCK_PAGES)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SpanSource)


def write_dump(pages: DataFrame, path: str, block: int = BLOCK_PAGES) -> None:
    """Adds pages (doc_id, pno, width, height, spans) to a dump in one commit. They are dealt by ranges of (doc_id, pno), so
    that a block has few documents and neighbouring pages; null numbers are refused, since ranges have none."""
    register(pages.sparkSession)
    checked = pages.select(F.coalesce("doc_id", F.raise_error(F.lit("a page has a document")).cast("long")).alias("doc_id"), F.coalesce("pno", F.raise_error(F.lit("a page has a number")).cast("int")).alias("pno"), "width", "height", "spans")
    dealt = checked.repartitionByRange("doc_id", "pno").sortWithinPartitions("doc_id", "pno")
    dealt.write.format("spans").mode("append").option("pages", str(block)).save(path)


def read_spans(spark: SparkSession, path: str, columns: str = SCHEMA, **ranges: int) -> DataFrame:
    """The spans of a dump. columns: the fields that are made, as a schema. ranges: doc_id_from, doc_id_to, pno_from, pno_to:
    blocks without such pages are not opened; rows outside are left out. Where the session has
    spark.sql.python.filterPushdown.enabled, filters of doc_id and pno choose blocks by themselves."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    asked = StructType.fromDDL(columns)
    needed = {n.rsplit("_", 1)[0] for n in ranges} - set(asked.names)  # made for the ranges' sake, and dropped
    whole = StructType([*asked.fields, *[f for f in StructType.fromDDL(SCHEMA) if f.name in needed]])
    reader = spark.read.format("spans").schema(whole).option("pushdown", pushed)
    for name, value in ranges.items():
        reader = reader.option(name, str(value))
    rows = reader.load(path)
    for name, value in ranges.items():
        column, end = name.rsplit("_", 1)
        rows = rows.where(F.col(column) >= value if end == "from" else F.col(column) <= value)
    return rows.select(*asked.names)


def stream_spans(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The spans of a dump as a stream: what each commit adds, once."""
    register(spark)
    return spark.readStream.format("spans").schema(columns).load(path)
