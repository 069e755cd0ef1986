"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import cut, discard, shared_dir
from foliant.llm.tokens import encoder, gathered
from foliant.ship import map_arrow

#: Ids of a block of a file at least, but for a file's last.
BLOCK = 1 << 20
#: Bytes of each of the four values that a control byte describes.
SIZES = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)

FILES = "part int, block int, start long, n long, keys array<{key}>, lengths array<long>, control binary, data binary"


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes, two bits a value with its bytes less 1, and the values' low bytes."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    width = int(size.max(initial=1))
    data = values.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in gathered(batches, "text"):
            for first, ids, at in enc.rows(batch.column(1), end):
                small = ids.astype("<u2") if not len(ids) or ids.max() < 65536 else None
                parts = [small[x:y].tobytes() if small is not None else b"\1" + ids[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(parts)), pa.array(parts, pa.binary())], ["key", "ids"])

    return run


def _ids(raw: bytes) -> np.ndarray:
    """Two bytes an id, or four after a byte of 1 where an id needs them."""
    return np.frombuffer(raw, "<u2").astype(np.uint32) if len(raw) % 2 == 0 else np.frombuffer(raw, "<u4", offset=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        rows = batch.column(0).to_pylist()
        small = np.frombuffer(b"".join([x for x in rows if len(x) % 2 == 0]), "<u2")
        for ids in (small, *[_ids(x) for x in rows if len(x) % 2]):
            n = np.bincount(ids)
            if len(n) > len(total):
                total, n = n, total
            total[: len(n)] += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _blocks(id_of_rank: np.ndarray, key_type: pa.DataType):
    rank_of = np.zeros(int(id_of_rank.max(initial=0)) + 1, np.uint32)
    rank_of[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        n = 0

        def block() -> pa.RecordBatch:
            control, data = pack_values(np.concatenate(held))
            row = {"part": part, "block": number, "start": start, "n": n, "keys": keys, "lengths": [len(x) for x in held], "control": control, "data": data}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(key_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            rows = batch.column(1).to_pylist()
            if all(len(x) % 2 == 0 for x in rows):
                ranks = np.split(rank_of[np.frombuffer(b"".join(rows), "<u2")], np.cumsum([len(x) // 2 for x in rows])[:-1]) if rows else []
            else:
                ranks = [rank_of[_ids(x)] for x in rows]
            for key, values in zip(batch.column(0).to_pylist(), ranks, strict=True):
                keys.append(key)
                held.append(values)
                n += len(values)
                if n >= BLOCK:
                    yield block()
                    number, start, keys, held, n = number + 1, start + n, [], [], 0
        if held:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, end: int, to: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Writes the token files of docs, in ascending order of the key (null first), and gives their folder: to, or a new one
    in the shared folder. It needs nothing else to be read.

    blocks: a file is a part; its rows are blocks of whole documents, with the ids before the block in its part, keys,
    lengths, control bytes and data bytes. ranks: the id of each frequency rank. Ids are written as their rank by falling
    count over all documents (ties: smaller id), so that the frequent ones take one byte. A null or empty text is the end
    id alone; equal keys stand side by side, by their ids' bytes; an empty table gives no blocks. Other columns are not
    read. Only one count for each id of the vocabulary comes to the driver.
    """
    import pyspark.sql.pandas.types as types

    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    key_field = docs.select(F.col(key)).schema[0]
    key_type = types.to_arrow_type(key_field.dataType)
    kind = key_field.dataType.simpleString()
    tokens = cut(map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), _tokenize(path, end), f"key {kind}, ids binary", keep=True), "token-ids", "zstd")
    counts = map_arrow(tokens.select("ids"), _count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranked = sorted(counts, key=lambda r: (-r["n"], r["id"]))
    spark.createDataFrame([(k, r["id"]) for k, r in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{to}/ranks")
    ordered = tokens.repartitionByRange(F.col("key"), F.xxhash64("ids")).sortWithinPartitions("key", "ids")
    map_arrow(ordered, _blocks(np.array([r["id"] for r in ranked], np.uint32), key_type), FILES.format(key=kind)).write.parquet(f"{to}/blocks")
    discard(tokens)
    return to


def _documents(id_of_rank: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of_rank[unpack_values(row["control"], row["data"], row["n"])].astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                texts = [ids[e - m : e] for e, m in zip(ends, lengths, strict=True)]
                n = len(texts)
                columns = [pa.array([row["part"]] * n, pa.int32()), batch.schema.field("keys").type.value_type, pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in texts], pa.int64())]
                columns[1] = pa.array(row["keys"], columns[1])
                names = ["part", "key", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tobytes() for x in texts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each document of the files in a folder: key, start (ids of all documents before it), n_tokens, ids_crc32 and, if
    asked for, its ids as little-endian unsigned 32-bit integers. All come from the bytes of the files; the ranks, at most
    one for each id of a vocabulary, go out with the code."""
    files = spark.read.parquet(f"{folder}/blocks")
    ranks = sorted(spark.read.parquet(f"{folder}/ranks").collect())
    id_of_rank = np.array([r["id"] for r in ranks], np.uint32)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    schema = f"part int, key {kind}, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = map_arrow(files.select("part", "start", "n", "keys", "lengths", "control", "data"), _documents(id_of_rank, with_ids), schema)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = found.join(F.broadcast(parts), "part")  # 12 bytes a file, and files are as many as partitions
    return joined.select(F.col("key").alias(key), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
