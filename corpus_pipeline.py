"""The corpus pipeline: each stage calls one operator, on what the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import minhash, mixing, packing, secret_scan, tokens, toxicity
from foliant.llm.common import scope, shared_dir, table
from foliant.llm.queries import TOXIC


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold stay, repeated rows too; so do null and empty texts, unless the model's
    constant is above it."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="__toxicity").where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays. Null and empty texts are in no group; rows of one
    id and other texts are documents of their own."""
    return minhash.one_of_each(docs, n=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, null and empty ones and repeated rows too; their secrets are masked where they stand."""
    return secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_findings(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; the one at a source's budget is cut. A document without words, null
    or empty, is never taken and leaves here; repeated rows are taken each for itself; null sources are one source."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, repeated ones too, with their ids and their places in sequences of 1024 tokens. A null or
    empty text is one piece, the end id."""
    return packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), end=2, capacity=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", one_near_duplicate),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Learned scores, signatures and packings are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again. What a stage's operators
    wrote for themselves goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path := f"{at}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
