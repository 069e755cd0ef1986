"""Best-fit packing of tokenized documents into sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliant.llm.common import bucket_count, cut, discard, hash_key, prefix_sums
from foliant.llm.tokens import encoder, gathered
from foliant.ship import map_arrow, ship

#: Distinct pieces of text that a worker remembers, and bytes of text that it takes together: it holds pieces besides.
PIECES_KEPT, BYTES = 350_000, 3 << 20
#: Ranges of sizes that are swept apart, and rows of a plan that are broadcast at most (40 bytes each).
RANGES, PLAN_ROWS = 4, 500_000
#: A gap of so many pieces' size takes as many of them as it holds at once.
MANY = 8

GAP, PIECE, PLACED, CHANGED = 0, 1, 2, 3
#: A run: pieces of one length (size) with n ranks from rank on; gaps of one size in n sequences from first on; or pieces
#: that have found a place: from rank on, each in turn to the sequences from first on, from offset on, so many a sequence.
RUNS = "kind int, size int, n long, rank long, first long, offset int, each int"


def sweep(runs: list[list], capacity: int) -> list[list]:
    """One pass over pieces and gaps by rising size. A gap's successor is the longest piece before it that is still free;
    runs that want each other are matched by rank, so that nothing is taken twice. Gaps that have changed come back as
    CHANGED: they do not meet pieces again in this pass."""
    out, free = [], []  # free: runs of pieces, the longest last
    for kind, size, n, rank, first, *_ in sorted(runs, key=lambda r: (r[1], -r[0], r[3], r[4])):  # pieces before gaps of their size
        if kind == PIECE:
            free.append([size, n, rank])
            continue
        while n and free:
            length, left, at = free[-1]
            each = max(1, min(size // length, left // n)) if size >= MANY * length else 1
            m = min(n, left // each)
            out.append([PLACED, length, m * each, at, first, capacity - size, each])
            if size > each * length:
                out.append([CHANGED, size - each * length, m, 0, first, 0, 0])
            free[-1][1:] = left - m * each, at + m * each
            if left == m * each:
                free.pop()
            n, first = n - m, first + m
        if n:
            out.append([GAP, size, n, 0, first, 0, 0])
    return out + [[PIECE, size, n, rank, 0, 0, 0] for size, n, rank in free]


def _swept(capacity: int, last: bool):
    """Of a task's rows: what a sweep leaves and makes. The last of a superstep makes CHANGED gaps gaps again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [list(r.values()) for batch in batches for r in batch.to_pylist()]
        done = [r for r in rows if r[0] > PIECE] + sweep([r for r in rows if r[0] <= PIECE], capacity)
        if last:
            done = [[GAP if r[0] == CHANGED else r[0], *r[1:]] for r in done]
        names = [c.split()[0] for c in RUNS.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)

    return run


def _written(runs: DataFrame, capacity: int) -> tuple[DataFrame, dict[str, int]]:
    """The runs as a table; and, seen as it is written, how many pieces are free and how many of them take more than half a
    sequence, their tokens, the shortest of them, the widest gap, and how many runs
    were placed now."""
    piece, size, n = F.col("kind") == PIECE, F.col("size").cast("long"), F.col("n")
    total = lambda of, when: F.coalesce(F.sum(F.when(when, of)), F.lit(0))
    seen = Observation()
    out = cut(
        runs.observe(
            seen, total(n, piece).alias("pieces"), total(n, piece & (2 * size > capacity)).alias("large"), total(n * size, piece).alias("tokens"),
            F.coalesce(F.min(F.when(piece, size)), F.lit(0)).alias("shortest"), F.coalesce(F.max(F.when(F.col("kind") == GAP, size)), F.lit(0)).alias("widest"),
            total(F.lit(1), F.col("kind") == PLACED).alias("placed"),
        ),
        "runs",
    )
    return out, seen.get


def best_fit(lengths: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The placements, as RUNS, of pieces counted by length (length, n), and how many they are.

    Bulk-synchronous best fit over runs, from the longest: pieces of one length are a run with a range of ranks, gaps of
    one size a range of sequences. A superstep sweeps pieces and gaps, dealt by ranges of their size, in all ranges at
    once; what a range has not matched is carried over its border and swept once more, together; then changed gaps take
    their new size, and the next superstep begins. Where nothing moves, sequences are opened: for each piece of more than
    half a sequence one, or as many as the rest fills; so too where the shortest piece is longer than the widest gap. Runs
    grow with capacity and supersteps, not with pieces; six numbers a superstep come to the driver, with its table.
    """
    spark = lengths.sparkSession
    ship(spark)
    zero = [F.lit(0).cast(t).alias(c) for c, t in (("first", "long"), ("offset", "int"), ("each", "int"))]
    start = lengths.select(F.lit(PIECE).alias("kind"), F.col("length").cast("int").alias("size"), "n", F.lit(0).cast("long").alias("rank"), *zero)
    state, seen = _written(start, capacity)
    opened, placed, steps = 0, 0, []
    while seen["pieces"]:
        state = state.where(F.col("kind") <= PIECE)  # what is placed stays in its superstep's table
        if not seen["placed"] or seen["shortest"] > seen["widest"]:
            new = seen["large"] or -(-seen["tokens"] // capacity)
            state = state.unionAll(spark.createDataFrame([(GAP, capacity, new, 0, opened, 0, 0)], RUNS))
            opened += new
        dealt = state.repartitionById(RANGES, (F.col("size") * RANGES / (capacity + 1)).cast("int"))
        border = dealt.mapInArrow(_swept(capacity, False), RUNS).repartitionById(RANGES + 1, F.when(F.col("kind") <= PIECE, RANGES).otherwise(F.pmod("size", F.lit(RANGES))).cast("int"))
        state, seen = _written(border.mapInArrow(_swept(capacity, True), RUNS), capacity)  # a few rows: workers keep their words
        steps.append(state.path_written)
        placed += seen["placed"]
    plan = spark.read.schema(state.schema).parquet(*steps) if steps else state
    return plan.where(F.col("kind") == PLACED), placed


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, PIECES_KEPT)
        for batch in gathered(batches, "__text", BYTES):
            names = [n for n in batch.schema.names if n != "__text"]
            for row, ids, at in enc.rows(batch.column("__text"), end, BYTES):
                # Where pieces begin: with a row, and at each whole capacity before a row's end.
                sizes = np.diff(at)
                parts = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), parts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                stop = sizes[of] - (parts[of] - 1 - piece) * capacity
                start = np.maximum(stop - capacity, 0)
                raw = [ids[x:y].tobytes() for x, y in zip(at[of] + start, at[of] + stop, strict=True)]
                kept = [batch.column(n).take(pa.array(of + row)) for n in names]
                made = [pa.array(piece, pa.int32()), pa.array(start), pa.array(stop - start), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pack(docs: DataFrame, path: str, end: int, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of docs: key, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit), sequence_id, offset.

    A document is its ids and the end id; only one longer than capacity is cut, its first piece being the shorter one.
    A null or empty text is the end id alone; rows of equal key are documents of their own; an empty table gives no
    pieces; texts may be of any length. Pieces are written once with their ids; a piece finds its place by its rank among
    those of its length.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = cut(
        map_arrow(
            docs.select(F.col(key).alias("key"), F.col(text).alias("__text")),
            _pieces(path, end, capacity), f"key {kind}, piece int, start long, length long, ids_crc32 long, ids binary", keep=True,
        ),
        "pieces", "zstd",
    )
    plan, rows = best_fit(pieces.groupBy(F.col("length").cast("int").alias("length")).agg(F.count("*").alias("n")), capacity)
    plan = plan.select(F.col("size").cast("long").alias("__length"), F.col("n").alias("__n"), F.col("rank").alias("__from"), "first", F.col("offset").alias("__offset"), "each")
    keyed = pieces.withColumn("__key", hash_key(F.col("key"), F.col("piece"), salt="pack"))
    ranked = prefix_sums(keyed, ["length"], "__key", None, "__rank", bucket_count(pieces.count()), ["key", "piece", "ids_crc32"])
    turn = F.col("__rank") - F.col("__from")
    found = ranked.join(F.broadcast(plan) if rows <= PLAN_ROWS else plan, (F.col("length") == F.col("__length")) & (turn >= 0) & (turn < F.col("__n")))
    sequence = (F.col("first") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id")
    offset = (F.col("__offset") + turn % F.col("each") * F.col("length")).cast("long").alias("offset")
    return found.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "ids", sequence, offset)
