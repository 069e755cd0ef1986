"""Cheapest repairs of conversations: a cost DP, then prefix-doubling ranks of the optimal arcs choose the least audit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut
from foliant.ship import map_arrow

#: Rows from which a conversation is repaired in pieces, on many workers.
LONG = 10_000
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What a repaired conversation has said so far: nothing, a system turn, a user turn, an assistant turn. It may end after
#: nothing and after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn, and its role.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept turn of initial s, u, a or another; -1: it may not be kept there.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Letters of audits by rising code, 0: the end.
LETTERS = "\0DIKR"
BLANK = r"[^\x20\x09-\x0D]"
LEGAL = frozenset([(0, 1), (1, 2), (2, 1)])
FAR = 1 << 40


def _relaxed(c: list[int]) -> list[int]:
    """Costs from the four states, when turns may be inserted first."""
    user = min(c[USER], INSERT + c[ASSISTANT])
    return [min(c[START], INSERT + user), min(c[SYSTEM], INSERT + user), user, min(c[ASSISTANT], INSERT + c[USER])]


#: Costs from the four states at the end of a conversation.
CLOSE = _relaxed([0, FAR, FAR, 0])

Turn = tuple[int, bool, bool]  # which initial (of KEPT), whether it must be deleted, whether it is truncated


def costs(turns: Sequence[Turn], at_end: Sequence[int]) -> list[list[int]]:
    """The least cost from each state before each turn to the end, where at_end are the costs from there on."""
    out, c = [list(at_end)], list(at_end)
    for letter, must, truncated in reversed(turns):
        base = [DELETE + x for x in c]
        if not must:
            extra = TRUNCATED * truncated
            for state in range(4):
                base[state] = min(base[state], REROLE + extra + c[NEXT[state]])
                if (kept := KEPT[state][letter]) >= 0:
                    base[state] = min(base[state], extra + c[kept])
        c = _relaxed(base)
        out.append(c)
    return out[::-1]


def matrix(turns: Sequence[Turn]) -> list[int]:
    """The least costs between the states before a piece of turns and those after it, by rows."""
    ends = [costs(turns, [0 if k == end else FAR for k in range(4)])[0] for end in range(4)]
    return [ends[after][before] for before in range(4) for after in range(4)]


def audits(turns: Sequence[Turn], at_end: Sequence[int], closes: bool) -> list[tuple[str, int]]:
    """For each state before the turns the least audit among the cheapest, and the state after it.

    Nodes are (turns done, state); the arcs that keep to the DP's costs are D, I, K and R, at most one of each letter at a
    node. Round k has for each node the rank of its least audit's first 2**k letters, and a pointer to where that leads;
    the next round ranks pairs of ranks, through the pointers, and doubles these. With all audits ranked, each node takes
    the arc of least (letter, rank of the rest), and the path is read off in doubling steps.
    """
    n = len(turns)
    c = np.array(costs(turns, at_end), np.int64)
    letter, must, truncated = (np.array([t[k] for t in turns], np.int64) for k in range(3))
    nodes = 4 * (n + 1)
    node = np.arange(nodes).reshape(n + 1, 4)
    target = np.tile(np.arange(nodes)[:, None], (1, 5))
    fits = np.zeros((nodes, 5), bool)
    flat = c.ravel()

    def arc(which: int, at: np.ndarray, to: np.ndarray, cost: np.ndarray | int, allowed: np.ndarray | bool) -> None:
        target[at, which] = to
        fits[at, which] = (flat[at] == flat[to] + cost) & (flat[at] < FAR) & allowed

    if n:
        here, after = node[:-1], node[1:]
        free, extra = (must == 0)[:, None], (TRUNCATED * truncated)[:, None]
        kept = KEPT[:, letter].T if n else KEPT[:0]
        arc(1, here, after, DELETE, True)
        arc(3, here, np.where(kept >= 0, 4 * np.arange(1, n + 1)[:, None] + np.maximum(kept, 0), here), extra, free & (kept >= 0))
        arc(4, here, after[:, NEXT], REROLE + extra, free)
    last = n + 1 if closes else n
    if last:
        arc(2, node[:last], node[:last][:, NEXT], INSERT, True)
    # The end: a node without arcs stays where it is. At the end of a conversation a state that may end does.
    some = fits.any(axis=1)
    which = np.where(some, fits.argmax(axis=1), 0)
    pointer = target[np.arange(nodes), which]
    rank, jump = which, pointer
    while (jump != pointer[jump]).any():
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
    order = np.where(fits, np.arange(5) * nodes + rank[target], 5 * nodes)
    which = np.where(some, order.argmin(axis=1), 0)
    pointer = target[np.arange(nodes), which]
    path, jump = node[0][:, None], pointer
    while (pointer[path[:, -1]] != path[:, -1]).any():
        path = np.concatenate([path, jump[path]], axis=1)
        jump = jump[jump]
    return [("".join(LETTERS[x] for x in which[p] if x), int(p[-1] % 4)) for p in path]


def repaired(audit: str, state: int, turns: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns (role, text) after the edits of an audit, from a state on."""
    out, at = [], 0
    for x in audit:
        if x == "D":
            at += 1
        elif x == "K":
            role, text = turns[at]
            out.append((role, text))
            state = KEPT[state][_letter(role)]
            at += 1
        else:
            state = int(NEXT[state])
            out.append((ROLE[state], turns[at][1] if x == "R" else ""))
            at += x == "R"
    return out


def _letter(role: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


def _illegal(letters: Sequence[int]) -> int:
    return sum(pair not in LEGAL for pair in zip(letters, letters[1:]))


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<struct<role:string,text:string>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _report(rows: list[tuple]) -> tuple:
    """The report of a whole conversation: rows (turn, role, text, blank, truncated), in order."""
    seen, turns, counts = set(), [], [0, 0, 0]
    for _, role, text, blank, truncated in rows:
        again = (role, text) in seen
        seen.add((role, text))
        fault = 0 if blank else 1 if again else 2 if truncated else 3
        if fault < 3:
            counts[fault] += 1
        turns.append((_letter(role), fault < 2, fault == 2))
    numbers = {r[0] for r in rows if r[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    audit, _ = audits(turns, CLOSE, True)[START]
    cost = costs(turns, CLOSE)[0][START]
    done = repaired(audit, START, [(r[1], r[2]) for r in rows])
    return (gaps, *counts, _illegal([t[0] for t in turns]), cost, audit, [{"role": a, "text": b} for a, b in done])


def _whole(long: int, key_type: pa.DataType):
    """Sorted rows (key, turn, role, text, blank, truncated, present): reports of the conversations that lie inside a
    partition, and the rows of those at its borders, which may go on in the next one, and of the long ones."""
    report = pa.struct([*[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("turns", _TURNS)])
    opened = pa.struct([("piece", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("blank", pa.bool_()), ("truncated", pa.bool_()), ("present", pa.bool_())])
    names = [f.name for f in report]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        out: list[list] = [[], [], []]
        current, held, inside, seq, piece, in_piece = object(), [], False, 0, -1, 0

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], key_type), pa.array(out[1], report), pa.array(out[2], opened)], ["key", "report", "open"])
            for x in out:
                x.clear()
            return batch

        def open_rows(key, rows: list[tuple]) -> None:
            nonlocal seq, in_piece, piece
            for turn, role, text, blank, truncated, present in rows:
                if in_piece == long:
                    piece, in_piece = piece + 1, 0
                out[0].append(key)
                out[1].append(None)
                out[2].append({"piece": part | piece, "at": part | seq, "turn": turn, "role": role, "text": text, "blank": blank, "truncated": truncated, "present": present})
                seq, in_piece = seq + 1, in_piece + 1

        started = False
        for batch in batches:
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if not started or key != current:
                    if inside:
                        out[0].append(current)
                        out[1].append(dict(zip(names, _report([r[:5] for r in held if r[5]]), strict=True)))
                        out[2].append(None)
                    elif held:
                        open_rows(current, held)
                    current, held, inside, piece, in_piece, started = key, [], started, piece + 1, 0, True
                held.append(tuple(row))
                if inside and len(held) > long or not inside and len(held) >= 1000:
                    open_rows(current, held)
                    held, inside = [], False
                if len(out[0]) >= 1000:
                    yield made()
        open_rows(current, held)
        yield made()

    return run


def _encoded(turns: list[dict]) -> list[Turn]:
    return [(t["letter"], t["must"], t["truncated"]) for t in turns]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = [_encoded(x) for x in batch.column(1).to_pylist()]
        ends = [([t[0] for t in x], x) for x in turns]
        columns = [
            batch.column(0), pa.array([matrix(x) for x in turns], pa.list_(pa.int64())), pa.array([_illegal(a) for a, _ in ends], pa.int64()), pa.array([a[0] for a, _ in ends], pa.int64()), pa.array([a[-1] for a, _ in ends], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "matrix", "illegal", "first", "last"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs after each piece of a conversation: suffix products of its pieces' matrices."""
    for batch in batches:
        piece, after = [], []
        for rows in batch.column(0).to_pylist():
            c = list(CLOSE)
            for k, row in enumerate(reversed(rows)):
                piece.append(row["piece"])
                after.append((list(c), k == 0))
                m = row["matrix"]
                c = [min(m[4 * a + b] + c[b] for b in range(4)) for a in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array([a for a, _ in after], pa.list_(pa.int64())), pa.array([b for _, b in after], pa.bool_())], ["piece", "after", "closes"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("audit", pa.string()), ("state", pa.int32())]))
    for batch in batches:
        found = [[{"audit": a, "state": s} for a, s in audits(_encoded(t), after, closes)] for t, after, closes in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["piece", "ways"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [[{"role": a, "text": b} for a, b in repaired(audit, state, [(r["role"], r["text"]) for r in rows])] for rows, audit, state in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, _TURNS)], ["piece", "done"])


def _in_pieces(rows: DataFrame) -> DataFrame:
    """The reports of the conversations whose rows (key, piece, at, turn, role, text, blank, truncated, present) lie in
    several partitions, or are many. A piece has a bounded number of rows; only what is made of a piece, a few numbers,
    and at the end its audit and turns, meet by conversation."""
    p = rows.where("present")
    firsts = p.groupBy("key", "role", F.md5(F.col("text").cast("binary"))).agg(F.min("at").alias("first")).select("first")
    marks = p.select("key", "piece", "at", "turn", "role", "blank", "truncated").join(firsts, F.col("at") == F.col("first"), "left")
    marks = marks.withColumn("duplicate", F.col("first").isNull() & ~F.col("blank")).withColumn("truncated", F.col("truncated") & ~F.col("blank") & ~F.col("duplicate"))
    letter = reduce(lambda c, x: F.when(F.left("role", F.lit(1)) == x[1], F.lit(x[0])).otherwise(c), enumerate("sua"), F.lit(3))
    marks = cut(marks.withColumn("letter", letter), "turns")
    turn = F.struct("at", "letter", (F.col("blank") | F.col("duplicate")).alias("must"), "truncated")
    pieces = marks.groupBy("piece").agg(F.any_value("key").alias("key"), F.sort_array(F.collect_list(turn)).alias("marks"))
    made = cut(map_arrow(pieces.select("piece", "marks"), _matrices, "piece long, matrix array<long>, illegal long, first long, last long").join(pieces.select("piece", "key"), "piece"), "piece-costs")
    chain = F.sort_array(F.collect_list(F.struct("piece", "matrix")))
    ends = map_arrow(made.groupBy("key").agg(chain.alias("m")).select("m"), _ends, "piece long, after array<long>, closes boolean")
    ways = map_arrow(pieces.select("piece", "marks").join(ends, "piece"), _audits, "piece long, ways array<struct<audit:string,state:int>>")

    def follow(a: Column, x: Column) -> Column:
        way = F.get(x["ways"], a["state"])
        return F.struct(way["state"].alias("state"), F.concat(a["out"], F.array(F.struct(x["piece"].alias("piece"), way["audit"].alias("audit"), a["state"].alias("state")))).alias("out"))

    none = F.struct(F.lit(START).alias("state"), F.array().cast("array<struct<piece:bigint,audit:string,state:int>>").alias("out"))
    chosen = ways.join(made.select("piece", "key"), "piece").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "ways"))).alias("w"))
    chosen = cut(chosen.select(F.explode(F.aggregate("w", none, follow, lambda a: a["out"])).alias("c")).select("c.*"), "audits")
    texts = p.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("rows")).join(chosen, "piece")
    done = map_arrow(texts.select("piece", "rows", "audit", "state"), _apply, "piece long, done array<struct<role:string,text:string>>")

    # The least cost of a conversation is that of its first piece to the end; the audit spells it, but for what truncated turns add.
    kept = done.join(chosen, "piece").join(made, "piece")
    part = F.sort_array(F.collect_list(F.struct("piece", "audit", "done", "illegal", "first", "last")))
    whole = kept.groupBy("key").agg(part.alias("parts"), F.sum("illegal").alias("inside"))
    legal = F.array(*[F.lit(4 * a + b) for a, b in sorted(LEGAL)])
    border = F.size(F.filter(F.transform("parts", lambda x, k: (k > 0) & ~F.array_contains(legal, F.get("parts", k - 1)["last"] * 4 + x["first"])), lambda x: x))
    whole = whole.select(
        F.col("key").alias("k"), F.array_join(F.transform("parts", lambda x: x["audit"]), "").alias("audit"), F.flatten(F.transform("parts", lambda x: x["done"])).alias("turns"), (F.col("inside") + border).cast("long").alias("illegal")
    )
    total = made.groupBy("key").agg(chain.alias("m"))
    product = lambda a, x: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.get(a, s) + F.get(x["matrix"], s * 4 + b))))
    begin = F.array(*[F.lit(0 if s == START else FAR).cast("long") for s in range(4)])
    end = F.array(*[F.lit(x).cast("long") for x in CLOSE])
    cost = total.select(F.col("key").alias("k"), F.array_min(F.zip_with(F.aggregate("m", begin, product), end, lambda a, b: a + b)).alias("cost"))
    numbers = marks.groupBy("key", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    numbers = numbers.groupBy(F.col("key").alias("k")).agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    found = rows.select("key").distinct()
    for other in (numbers, whole, cost):
        found = found.join(other, F.col("key").eqNullSafe(F.col("k")), "left").drop("k")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.withColumns(zero).withColumns({"audit": F.coalesce("audit", F.lit("")), "turns": F.coalesce("turns", F.array().cast("array<struct<role:string,text:string>>"))})


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, long: int = LONG) -> DataFrame:
    """A row for each conversation: key, gaps (missing numbers between its turns'), blank, duplicate and truncated (turns whose
    first fault that is), illegal (neighbours that may not follow each other), cost, audit and turns, an array of (role,
    text): what is left after the cheapest edits that make the roles' initials (s?(ua)+)?, or nothing.

    Keeping is free, another role costs 2, deleting 3, an inserted empty turn 2, and a truncated turn that stays 1; blank
    and repeated turns must go. audit: the edits' letters K, R, D, I; of cheapest ones the least by code point. Turns are
    taken by number, null first; rows of one number by role, then by md5 of the text. Null roles and texts are one space; so a null
    text is blank. Null keys are one conversation. present: a column that is false for rows that only name their
    conversation; one without turns has zeros, an empty audit and no turns. Texts may be of any length; an empty table gives
    no rows; other columns are not read.

    Rows are dealt by ranges of (key, turn, ...), so a conversation of any size is spread over partitions. One that lies
    inside a partition is repaired there; those at borders, and those above long rows, in pieces of at most long rows:
    each gives the costs between the states before and after it, these are multiplied, and then each piece is ranked by
    itself for every state it may begin in.
    """
    import pyspark.sql.pandas.types as types

    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    last = F.regexp_extract(F.col("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = conversations.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), (F.col(present) if present else F.lit(True)).alias("present"))
    rows = rows.select("key", "turn", "role", "text", (~F.col("text").rlike(BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), "present")
    order = [F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("uid", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order, F.col("uid").asc()).sortWithinPartitions(*order).drop("digest", "uid")
    field = rows.schema["key"]
    report = "struct<" + ",".join(":".join(c.split(" ", 1)) for c in REPORT.split(", ")) + ">"
    opened = "struct<piece:bigint,at:bigint,turn:bigint,role:string,text:string,blank:boolean,truncated:boolean,present:boolean>"
    kind = f"key {field.dataType.simpleString()}, report {report}, open {opened}"
    done = cut(map_arrow(dealt, _whole(long, types.to_arrow_type(field.dataType)), kind), "conversations")
    columns = [c.split(" ", 1)[0] for c in REPORT.split(", ")]
    whole = done.where(F.col("report").isNotNull()).select("key", "report.*")
    rest = _in_pieces(done.where(F.col("open").isNotNull()).select("key", "open.*"))
    return whole.select("key", *columns).unionByName(rest.select("key", *columns)).withColumnRenamed("key", key)
