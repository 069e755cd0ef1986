"""Near-duplicate documents: MinHash signatures, an inverted join of their coordinates, and exact confirmation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, discard
from foliant.llm.components import components
from foliant.llm.kernels import U, buffers, grams, slices, stir, words
from foliant.llm.vector_dedup import roots
from foliant.llm.vectors import numbered
from foliant.ship import map_arrow

#: Coordinates of a signature, and matching ones that make a candidate pair. At a similarity of 0.8 fewer match for
#: about one pair in a million; pairs are then confirmed on their whole sets.
COORDINATES, MATCHES = 32, 13
#: Documents of a block: a posting list or cluster of more is compared block by block.
BLOCK = 256
#: Members of a cluster that stand in all its blocks, on average.
PIVOTS = 8
#: A posting list of more classes is not compared: its classes are one cluster.
HOT = 1 << 16
#: Blocks outside a cluster's largest component from which it is divided: until then a set is copied twice so often at most.
WIDE = 16
#: A shingle that one in so many members of a cluster has comes last in the order of its shingles.
COMMON = 8

_RANDOM = np.random.default_rng(606)
_MULTIPLY = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
_ADD = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each row's distinct hashes of n words in a row, in order; of all its words, if they are fewer."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        hashes, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        every = grams(hashes, n, n)
        for x, y in zip(at, at[1:], strict=False):
            if y - x >= n:
                yield np.unique(every[x : y - n + 1])
            elif y > x:
                yield grams(hashes[x:y], int(y - x), int(y - x))
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 1 << 14):
        part = shingles[None, k : k + (1 << 14)] * _MULTIPLY[:, None] + _ADD[:, None]
        out = np.minimum(out, part.min(1) >> U(32))
    return out.astype("<u4")


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, for finding equal ones."""
    a = stir(shingles ^ U(0x1234567890ABCDEF)).sum(dtype=np.uint64)
    b = stir(shingles * U(0x9FB21C651E98DF25) + U(7)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, d1, d2, sig = [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                size.append(len(s))
                x, y = digest(s) if len(s) else (0, 0)
                d1.append(x)
                d2.append(y)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "d1", "d2", "sig"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 64-bit token for each coordinate and its value."""
    place = np.arange(COORDINATES, dtype=np.uint64) << U(32)
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES)
        tokens = stir(sig.astype(np.uint64) | place).view(np.int64)
        ids = np.repeat(batch.column(0).to_numpy(), COORDINATES)
        which = np.tile(np.arange(COORDINATES, dtype=np.int32), len(sig))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tokens.ravel()), pa.array(which)], ["id", "token", "which"])


def grouped(columns: list[str], out: list[str], work: Callable[[dict[str, np.ndarray | list]], list[np.ndarray]]):
    """A mapInArrow function over rows sorted by columns: calls work with each group's other columns, across batches.
    A group must fit into memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[list[np.ndarray]] = [[] for _ in out]

        def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = [table.column(c).to_numpy() for c in columns]
            change = np.zeros(max(0, table.num_rows - 1), bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            ends = [*(np.flatnonzero(change) + 1).tolist(), table.num_rows]
            rest = {c: table.column(c).to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in table.schema.names if c not in columns}
            a = 0
            for b in ends:
                if b - a > 1:
                    for to, value in zip(made, work({c: v[a:b] for c, v in rest.items()}), strict=True):
                        to.append(value)
                a = b
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(m)) for m in made], out)
                for m in made:
                    m.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            same = np.ones(table.num_rows, bool)
            for c in columns:
                v = table.column(c).to_numpy()
                same &= v == v[-1]
            first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if first:
                yield from finish(table.slice(0, first))
            held = table.slice(first).to_batches()
        if held:
            yield from finish(pa.Table.from_batches(held))

    return run


def _forest(ids: np.ndarray, linked: np.ndarray) -> list[np.ndarray]:
    """Links of a group as edges to the least place of each component."""
    linked |= linked.T
    np.fill_diagonal(linked, False)
    root = roots(linked, True)[0]
    hit = np.flatnonzero(root != np.arange(len(ids)))
    return [ids[hit], ids[root[hit]]]


def _match(group: dict) -> list[np.ndarray]:
    """Candidates of a tile of a posting list: signatures that match in enough coordinates. A pair that meets in the
    list of an earlier coordinate too is skipped: it counts there."""
    sig = np.frombuffer(b"".join(group["sig"]), "<u4").reshape(-1, COORDINATES)
    count = np.zeros((len(sig), len(sig)), np.uint8)
    before = np.zeros(count.shape, bool)
    for k in range(COORDINATES):
        same = sig[:, k, None] == sig[None, :, k]
        count += same
        if k < group["which"][0]:
            posted = group["posted"] >> k & 1 == 1
            before |= same & posted[:, None] & posted[None, :]
    return _forest(group["id"], (count >= MATCHES) & ~before)


def _confirm(percent: int):
    def work(group: dict) -> list[np.ndarray]:
        """Links of a block of a cluster, by whole sets."""
        ids, once = np.unique(group["id"], return_index=True)  # repeated rows repeat their sets
        sets = [np.frombuffer(group["shingles"][k], "<u8") for k in once]
        size = np.array([len(x) for x in sets], np.int64)
        own = np.repeat(np.arange(len(sets)), size)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, own = every[order], own[order]
        new = np.append(True, every[1:] != every[:-1])
        token = np.cumsum(new) - 1
        shared = np.bincount(token) > 1
        keep = shared[token]
        token, own = (np.cumsum(shared) - 1)[token[keep]], own[keep]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for k in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(token, (k, k + 4096))
            has = np.zeros((len(sets), min(4096, int(shared.sum()) - k)), np.float32)
            has[own[a:b], token[a:b] - k] = 1
            common += has @ has.T
        common = common.astype(np.int64)
        union = size[:, None] + size[None, :] - common
        return _forest(ids, 100 * common >= percent * union)

    return work


def _cluster_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, text, d1, d2, cluster, size: the sets of rows that are their class's."""
        for batch in batches:
            found = []
            keep = []
            for k, (s, d1, d2) in enumerate(zip(shingle_sets(batch.column(1), n), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if digest(s) == (d1, d2):
                    found.append(s.tobytes())
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(4).take(at), batch.column(5).take(at), pa.array(found, pa.binary())], ["id", "cluster", "size", "shingles"])

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row key, n_shingles, component_id and kept.

    A document's set has its distinct runs of n words, A-Z as a-z (all its words as one, if they are fewer). Documents
    link when 100 times the intersection of their sets is at least percent times the union. component_id: the least key
    reached by links, or the own one; kept: the own one is it. A text that is null or without words has an empty set and
    links with nothing; so does a null key. Rows that share a key are one node. An empty table gives no rows.

    1. Equal sets, however many, become one class with its least key. 2. A class posts itself under its coordinate and
    value pairs. Two classes with MATCHES of COORDINATES in common share one of the COORDINATES - MATCHES + 1 rarest
    pairs of each, so only that prefix is posted; pairs that occur once are skipped. Posting lists are compared in tiles
    of blocks, and a tile gives the forest of its candidates, not the pairs; the classes of a list of more than HOT are
    tied together without comparison. 3. Candidates' components are clusters. They are confirmed on whole sets, in blocks
    that share some pivots; what then is outside the largest component of a cluster of several blocks is held against all
    its blocks. 4. Where more than WIDE blocks are outside, the cluster is divided before: linked sets share one of the rarest
    of their shingles, so classes that share none of these part (_divided). So every candidate pair is confirmed, or is
    connected by confirmed links already, or has too little in common. Texts may be of any length. Keys are whole numbers.
    """
    rows = docs.select(numbered(docs, key).alias("id"), F.col(text).alias("text"))
    signed = cut(map_arrow(rows, _sign(n), "id long, n long, d1 long, d2 long, sig binary"), "signatures")
    classes = cut(
        signed.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.min("sig").alias("sig")), "classes"
    )
    clusters = _clusters(classes)
    found = _confirmed(rows, classes, clusters, n, percent)
    of_class = classes.join(found.withColumnRenamed("component", "least"), "id", "left").select("n", "d1", "d2", F.coalesce("least", "id").alias("component"))
    # Rows that share a key but not a text: the least component of any.
    joined = signed.select("id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    component = F.coalesce(F.least("component", "id"), F.col("id"))
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _clusters(classes: DataFrame) -> DataFrame:
    """id and cluster of all classes that are candidates with another."""
    posted = map_arrow(classes.select("id", "sig"), _tokens, "id long, token long, which int")
    often = posted.groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") > 1)
    prefix = COORDINATES - MATCHES + 1
    tokens = cut(
        posted.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("times", "token", "which"))).alias("tokens"))  # COORDINATES at most
        .where(F.size("tokens") >= MATCHES)
        .withColumn("tokens", F.slice("tokens", F.lit(1), F.greatest(F.lit(0), prefix - COORDINATES + F.size("tokens"))))
        .withColumn("posted", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.call_function("shiftleft", F.lit(1).cast("long"), t["which"]))),
        "posted",
    )
    hot = tokens.select(F.col("id").alias("a"), F.explode(F.filter("tokens", lambda t: t["times"] > HOT)).alias("t")).select("a", "t.token")
    tied = _tied(hot.join(cut(hot.groupBy("token").agg(F.min("a").alias("b")), "hot-lists"), "token").select("a", "b"))
    lists = (
        tokens.withColumn("t", F.explode(F.filter("tokens", lambda t: t["times"] <= HOT))).drop("tokens")
        .join(classes.select("id", "sig"), "id").select("id", "sig", "posted", "t.token", "t.which", "t.times")
    )
    blocks = F.ceil(F.col("times") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiled = (
        lists.withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "sig", "posted", "which")
    )
    dealt = tiled.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "id")
    edges = map_arrow(dealt, grouped(["token", "i", "j"], ["a", "b"], _match), "a long, b long")
    found = components(edges.unionAll(tied))
    return cut(found.select("id", F.col("component").alias("cluster")).unionAll(found.select(F.col("component").alias("id"), F.col("component").alias("cluster")).distinct()), "clusters")


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster, size, shingles: how often each shingle occurs in a batch's sets of a cluster."""
    for batch in batches:
        cluster, size, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for c in np.unique(cluster):
            own = np.flatnonzero(cluster == c)
            shingle, n = np.unique(np.frombuffer(b"".join([raw[k] for k in own]), "<i8"), return_counts=True)
            every = [np.full(len(n), v) for v in (c, size[own[0]])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, every), pa.array(shingle), pa.array(n)], ["cluster", "size", "shingle", "n"])


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, cluster, shingles, common: each set's shingles, common ones last, up to where a linked set must share one."""
        for batch in batches:
            ids, clusters, out = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for raw, common in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = np.frombuffer(raw, "<i8")
                s = s[np.argsort(np.isin(s, np.array(common or [], np.int64)), kind="stable")]
                out.append(s[: len(s) + (-percent * len(s)) // 100 + 1])
            sizes = [len(s) for s in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(clusters, sizes)), pa.array(np.concatenate(out) if out else np.empty(0, np.int64))], ["id", "cluster", "shingle"])

    return run


def _tied(edges: DataFrame) -> DataFrame:
    """Edges from members of lists (a) to the least of each list (b), some for each member: a member and all that it is tied
    to are tied to the least of these, an edge a member and few others."""
    least = edges.groupBy("a").agg(F.collect_set("b").alias("b")).withColumn("m", F.array_min("b"))
    return least.select(F.explode(F.array_union(F.array("a"), "b")).alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _divided(sets: DataFrame, percent: int) -> DataFrame:
    """sets (id, cluster, size, shingles) of large clusters, in smaller ones; sets that can have no link are left out.

    A set that links has percent of its shingles, at least, in the other one, so in any order of shingles the two share
    one of their first 100 - percent, and one more. Common ones stand last, so that what many sets have in common, such as
    a template's text, ties nothing together. Sets that share such a shingle, directly or by others, stay together. The
    common shingles of a cluster are at most COMMON times those of a mean set.
    """
    counts = map_arrow(sets.select("cluster", "size", "shingles"), _often, "cluster long, size long, shingle long, n long")
    common = counts.groupBy("cluster", "size", "shingle").agg(F.sum("n").alias("n")).where(F.col("n") * COMMON > F.col("size"))
    common = cut(common.groupBy("cluster").agg(F.collect_list("shingle").alias("common")), "common")
    known = sets.select("id", "cluster", "shingles").join(common, "cluster", "left").select("id", "cluster", "shingles", "common")
    posted = cut(map_arrow(known, _prefixes(percent), "id long, cluster long, shingle long"), "prefixes")
    lists = cut(posted.groupBy("cluster", "shingle").agg(F.min("id").alias("b"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n"), "prefix-lists")
    found = components(_tied(posted.join(lists, ["cluster", "shingle"]).select(F.col("id").alias("a"), "b")))
    placed = cut(found.select("id", "component").unionAll(found.select(F.col("component").alias("id"), "component").distinct()), "divided")
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    of = placed.join(sizes, "component").select("id", F.col("component").alias("cluster"), "size")
    out = cut(sets.select("id", "shingles").join(of, "id").select("id", "cluster", "size", "shingles"), "sets")
    for written in (common, posted, lists, placed):
        discard(written)
    return out


def _confirmed(rows: DataFrame, classes: DataFrame, clusters: DataFrame, n: int, percent: int) -> DataFrame:
    """id and component by confirmed links."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    members = clusters.join(sizes, "cluster").join(classes.select("id", "d1", "d2"), "id").select("id", "d1", "d2", "cluster", "size")
    texts = rows.join(members, "id").select("id", "text", "d1", "d2", "cluster", "size")
    sets = cut(map_arrow(texts, _cluster_sets(n), "id long, cluster long, size long, shingles binary"), "sets")
    edges, found = _links(sets, percent, True)
    return found if found is not None else components(reduce(DataFrame.unionAll, edges))


def _links(sets: DataFrame, percent: int, divide: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of confirmed links of clusters, and their components, if they are known already."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit("pivot")), F.col("size")) < PIVOTS)
    placed = sets.withColumn("blocks", blocks).withColumn("own", own)
    first = placed.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    confirm = _confirm(percent)
    dealt = first.select("cluster", "block", "id", "shingles").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "id")
    edges = cut(map_arrow(dealt, grouped(["cluster", "block"], ["a", "b"], confirm), "a long, b long"), "links")
    found = components(edges)
    if not sets.where(F.col("size") > BLOCK).limit(1).count():
        return [edges], found
    # Clusters of several blocks: what is outside the largest component so far meets all blocks, or they are divided.
    split = placed.where(F.col("blocks") > 1)
    labelled = split.join(found, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    most = labelled.groupBy("cluster", "label").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("total"), F.max("k").alias("k"))
    most = cut(most.select("cluster", "main", F.ceil((F.col("total") - F.col("k")) / BLOCK).cast("int").alias("outer")), "main")
    made = [edges]
    if divide:
        wide = F.col("outer") > WIDE
        if most.where(wide).limit(1).count():
            made += _links(_divided(sets.join(most.where(wide), "cluster", "left_semi"), percent), percent, False)[0]
        most = most.where(~wide)
    labelled = labelled.join(most, "cluster")
    outside = labelled.where(F.col("label") != F.col("main"))
    mine = F.pmod(F.xxhash64("id", F.lit("outer")), F.col("outer")).cast("int")
    left = outside.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = labelled.where(F.col("outer") > 0).withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))
    both = left.unionByName(right).select("cluster", "i", "j", "id", "shingles")
    dealt = both.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    more = map_arrow(dealt, grouped(["cluster", "i", "j"], ["a", "b"], confirm), "a long, b long")
    known = labelled.select("id", "label")
    for c in ("a", "b"):
        more = more.join(known.select(F.col("id").alias(c), F.col("label").alias(f"of_{c}")), c)
    apart = cut(more.where(F.col("of_a") != F.col("of_b")).select("a", "b").distinct(), "late-links")
    if len(made) == 1 and not apart.limit(1).count():
        return made, found
    return [*made, apart], None


def _row_hash(key: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def _with_row(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with __row, a number of their key and text, and __is, what these are by 128 bits and more. Rows that are not the
    same never share a number: those whose hashes meet (2 ** -64 a pair) are told apart by __is, and get another hash."""
    named = docs.withColumn("__is", F.struct(F.col(key).alias("key"), F.md5(F.col(text).cast("binary")).alias("digest"), F.length(F.col(text)).alias("length"))).withColumn("__row", _row_hash(key, text, 0))
    seed = 0
    while True:
        met = named.select("__row", "__is").distinct().groupBy("__row").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("__row")
        if met.isEmpty():
            return named
        seed += 1
        met = cut(met, "rows-met").withColumn("__met", F.lit(True))
        named = named.join(met, "__row", "left").withColumn("__row", F.when(F.col("__met"), _row_hash(key, text, seed)).otherwise(F.col("__row"))).drop("__met")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows without near duplicates: of each group the row of the least key stays, once.

    Rows of one key and different texts are rows of their own: both stay, if their texts are not linked. Rows of equal key
    and text are one; of these the one whose other columns hash least stays. Rows of null key all stay. Null and empty
    texts are in no group.
    """
    columns = docs.columns
    named = _with_row(docs.where(F.col(key).isNotNull()), key, text)
    found = near_duplicates(named.drop("__is"), n, percent, "__row", text).select("__row", "component_id")
    least = named.select(key, "__row").join(found, "__row").groupBy("component_id").agg(F.min(F.struct(key, "__row")).alias("least"))
    stay = named.join(least.select("least.__row"), "__row", "left_semi").groupBy("__row").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")).select("r.*")
    return stay.unionByName(docs.where(F.col(key).isNull()))
