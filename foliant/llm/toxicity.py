"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.kernels import NOT_ALNUM, U, buffers, slices, stir, words
from foliant.ship import map_arrow

#: Labelled documents that the model is fitted on at most: those whose ids hash lowest. Scores cover all documents.
SAMPLE = 10_000
BITS = 20


@dataclass(frozen=True)
class Ftrl:
    """l1: 6 found as many held-out toxic documents as smaller values, or more, with 150 to 2,636 labels (README). alpha and beta set the learning rate of a coordinate, alpha / (beta + root of its summed squared gradients)."""

    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 6


@dataclass(frozen=True)
class Model:
    """Its coordinates that are not 0, in order, and their weights; the first is the constant."""

    index: np.ndarray
    weight: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates, from 1, of all words, pairs of neighbours and pairs with one word between; and each one's row."""
    hashes, at = words(data, offsets, NOT_ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    found, rows = [hashes], [row]
    for salt, step in ((1, 1), (2, 2)):
        a, b = hashes[:-step], hashes[step:]
        same = row[:-step] == row[step:]
        found.append(stir(a * U(0xA0761D6478BD642F) + b + U(salt))[same])
        rows.append(row[:-step][same])
    return (np.concatenate(found) >> U(64 - BITS)).astype(np.int64) + 1, np.concatenate(rows)


def fit(documents: list[np.ndarray], labels: list[int], how: Ftrl = Ftrl()) -> Model:
    """documents: the distinct coordinates of each, without the constant; an empty list gives a model without weights."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        own = z[i]
        w = -(own - np.sign(own) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
        return np.where(np.abs(own) <= how.l1, 0.0, w)

    for _ in range(how.epochs):
        for i, y in zip(documents, labels, strict=True):
            i = np.append(i, 0)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / how.alpha * w
            n[i] = more
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w)
    return Model(kept, w[kept])


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, how: Ftrl = Ftrl()) -> Model:
    """Fits on labelled rows of docs that are not held out, sample of them at most. Rows with a null key or label are
    left out; of a key's labels the greatest counts, of its texts the one whose coordinates come first, so
    that reruns agree. Texts may be of any length."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64(key, F.lit(8)), key).limit(sample)
    rows = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key)  # sample rows at most

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            found: list[np.ndarray] = []
            for a, b in slices(offsets):
                index, row = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.unique(row << (BITS + 1) | index)
                parts = np.searchsorted(order, np.arange(b - a + 1) << (BITS + 1))
                found += [(order[x:y] & ((1 << (BITS + 1)) - 1)).astype(np.int32) for x, y in zip(parts, parts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "label", "index"])

    kind = docs.schema[key].dataType.simpleString()
    found = map_arrow(rows.select(key, "__text", "__label"), distinct, f"key {kind}, label int, index binary")
    found = found.groupBy("key").agg(F.max("label").alias("label"), F.min("index").alias("index"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(str(r["key"]), r["label"], r["index"]) for batch in batches for r in batch.to_pylist()]
        order = np.random.default_rng(8).permutation(len(seen))
        seen.sort()
        seen = [seen[k] for k in order]
        model = fit([np.frombuffer(x[2], np.int32) for x in seen], [x[1] for x in seen], how)
        yield pa.RecordBatch.from_arrays([pa.array([model.index.astype("<i8").tobytes()]), pa.array([model.weight.astype("<f8").tobytes()])], ["index", "weight"])

    model = map_arrow(found.coalesce(1), learn, "index binary, weight binary").first()
    return Model(np.frombuffer(model["index"], "<i8"), np.frombuffer(model["weight"], "<f8"))


def score_texts(data: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
    out = np.empty(len(offsets) - 1)
    for a, b in slices(offsets):
        index, row = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hit = np.flatnonzero(dense[index])
        once = np.unique(row[hit] << (BITS + 1) | index[hit])
        w = dense[once & ((1 << (BITS + 1)) - 1)]
        out[a:b] = dense[0] + np.bincount(once >> (BITS + 1), w, b - a)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1; a null or empty text scores as the model's constant alone.

    The weights go to the executors with the code: at most 2 ** BITS of them, and L1 leaves few.
    """
    fields = [f for f in docs.schema if f.name != name]
    columns = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1)
        dense[model.index] = model.weight
        for batch in batches:
            scores = score_texts(*buffers(batch.column("__text")), dense)
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores)], [*columns, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*fields, StructField(name, DoubleType())])
    return map_arrow(docs.select(*columns, F.col(text).alias("__text")), run, schema)
