"""Mixing sources to target weights, over hash-random orders and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import WORD, bucket_count, cut, hash_key, prefix_sums


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size) with target.

    Sources by code point, null last, get the weights in turn. All targets sum to share times all sizes (or to cap
    times them, if that is less), in proportion to the weights, but none is above cap times its source's size; what is
    cut off goes to the others by weight. Only one sum of caps and one of weights a step come to the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    ranked = cut(
        sizes.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("__cap", F.col("source_size") * F.lit(float(cap))),
        "mix-sources",
    )
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("__cap") <= F.lit(level) * F.col("__weight")
        n, caps, rest = ranked.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("__cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("__weight"))), F.lit(0.0))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, max(level, (total - caps) / rest)
    target = F.least(F.col("__cap"), F.lit(level) * F.col("__weight")) if rest else F.col("__cap")
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """docs, their columns in keep (None: all), with size, source_size, target and taken.

    size: words of the text (null: 0). taken: words that the mix takes of the row. Rows of a source stand in the order
    of a hash of their key; whole epochs of a source are taken while its target lasts, then rows in that order, and the
    row at the budget's end is cut there. Each source's taken words sum to its target, rounded down. Null sources are
    one source; rows without words take nothing; repeated rows are rows of their own; texts may be of any length. An empty table
    gives no rows. Columns of docs with these names are replaced. Texts are read once where they are not kept: key, source
    and size are then written to the shared folder, and all sums are made from that.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    kept = docs.columns if keep is None else list(dict.fromkeys([*keep, key, source]))
    sized = docs.select(*kept, size)
    if text not in kept:
        sized = cut(sized, "mix-sizes")
    goals = targets(
        sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size")), weights, share, cap
    ).withColumnRenamed("source", "__source")
    keyed = sized.withColumn("__key", hash_key(F.col(key), salt="mix"))
    ran = prefix_sums(keyed, [source], "__key", F.col("size"), "__before", bucket_count(sized.count()), [key, "size"])
    joined = ran.join(goals, ran[source].eqNullSafe(goals["__source"]), "inner").drop("__source")
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("__before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.withColumn("taken", taken.cast("long")).drop("__key", "__before")


def mixed_rows(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix as rows with docs' own columns: a row for each time that its text is taken whole, and one for the words
    of a last, cut time. Columns of docs that have the names of the mix's own keep their values."""
    columns = docs.columns
    own = {c: f"__own_{c}" for c in ("size", "source_size", "target", "taken") if c in columns}
    mixed = mix(docs.withColumnsRenamed(own), text=text, **how)
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    times = F.concat(
        F.when(whole > 0, F.array_repeat(F.lit(-1).cast("long"), whole.cast("int"))).otherwise(F.array().cast("array<long>")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")),
    )
    out = mixed.withColumn("__words", F.explode(times))
    # The first words of the row that the budget ends in: a prefix up to the last of them.
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut_text = F.when(F.col("__words") < 0, F.col(text)).otherwise(F.concat_ws("", F.slice(parts, F.lit(1), F.col("__words").cast("int"))))
    out = out.withColumn(text, cut_text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length(F.col(text)).cast("long"))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in columns])
