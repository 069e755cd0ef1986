"""Operators on rows written here, and folds against plain Python."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import checks, chunking, html, layout, links, paragraphs, quality, regions, status


def blocks(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id long, idx int, text string")


def texts(df):
    return [r["text"] for r in df.orderBy("doc_id", "idx").collect()]


def test_merge_moves_notes_and_stops_at_headings(spark):
    made = ["The model is not", "> note 1", "complete here.", "Another goes", "## Head", "on and on"]
    assert texts(paragraphs.merge_continuations(blocks(spark, made))) == ["The model is not complete here.", "> note 1", "Another goes", "## Head", "on and on"]


def test_merge_three_pieces(spark):
    assert texts(paragraphs.merge_continuations(blocks(spark, ["One commu-", "nity of", "many parts.", "End."]))) == ["One community of many parts.", "End."]


def plain_merge(items):
    out, i = [], 0
    body = lambda t: not t.startswith(("#", ">", "!"))
    while i < len(items):
        now, moved, i = items[i], [], i + 1
        while body(now) and not now.endswith(".") and i < len(items):
            k = i
            while k < len(items) and not body(items[k]) and not items[k].startswith("#"):
                k += 1
            if k == len(items) or items[k].startswith("#") or not items[k][0].islower():
                break
            now, moved, i = f"{now} {items[k]}", moved + items[i:k], k + 1
        out += [now, *moved]
    return out


def test_merge_against_a_loop(spark):
    rng = random.Random(5)
    made = [[rng.choice(["Aa", "bb", "Cc.", "dd.", "> n", "# H", "![i]"]) + str(k) * 0 for k in range(rng.randint(1, 14))] for _ in range(60)]
    rows = spark.createDataFrame([(d, i, t) for d, m in enumerate(made) for i, t in enumerate(m)], "doc_id long, idx int, text string")
    got = {}
    for r in paragraphs.merge_continuations(rows).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {d: plain_merge(m) for d, m in enumerate(made)}


def test_running_heads(spark):
    made = ["# Preprint not peer reviewed", "Preprint not peer reviewed the text", "plain"]
    heads = spark.createDataFrame([(1, ["preprint not peer reviewed"])], "doc_id long, norms array<string>")
    assert texts(paragraphs.strip_running_heads(blocks(spark, made), heads)) == ["the text", "plain"]


def test_cover_math_images_and_notes(spark):
    made = ["JSTOR is a not-for-profit", "A = θ S (6)", "![a](b.png)", "2. Ferguson says", "Figure 1. x"]
    rows = blocks(spark, made)
    assert texts(paragraphs.drop_images(paragraphs.drop_math(paragraphs.drop_cover(rows)))) == made[3:]
    noted = rows.withColumn("size", F.when(F.col("idx") >= 3, 6.5)).withColumn("note", F.lit(False)).withColumn("body_size", F.lit(8.0))
    assert texts(paragraphs.mark_footnotes(noted))[3:] == ["> **각주 2** Ferguson says", "Figure 1. x"]


def test_rebuild(spark):
    units = blocks(spark, ["The model is", "developed in communi-", "cation here.", "# Head", "A second one"])
    seq = spark.createDataFrame([(1, 0, "themodelis", True), (1, 1, "developedincommuni", False), (1, 2, "cationhere", False), (1, 3, "asecondone", True)], "doc_id long, idx int, key string, is_start boolean")
    got = paragraphs.rebuild_paragraphs(units, seq).orderBy("idx").collect()
    assert [(r["key0"], r["text"]) for r in got] == [("themodelis", "The model is developed in communication here."), ("head", "# Head"), ("asecondone", "A second one")]


def plain_rebuild(units, seq):
    out, at = [], 0
    for key, marked in units:
        hit = [k for k in range(3) if at + k < len(seq) and seq[at + k][0] == key]
        new = any(k == key and f for k, f in seq) if not hit else seq[at + hit[0]][1]
        at += hit[0] + 1 if hit else 0
        out.append(marked or new or not out)
    return out


def test_rebuild_against_a_loop(spark):
    rng = random.Random(6)
    docs = [([(rng.choice("abcdef"), rng.random() < 0.1) for _ in range(rng.randint(1, 30))], [(rng.choice("abcdefg"), rng.random() < 0.4) for _ in range(rng.randint(0, 25))]) for _ in range(80)]
    units = spark.createDataFrame([(d, k, ("# " if m else "") + t) for d, (u, _) in enumerate(docs) for k, (t, m) in enumerate(u)], "doc_id long, idx int, text string")
    seq = spark.createDataFrame([(d, k, t, f) for d, (_, s) in enumerate(docs) for k, (t, f) in enumerate(s)], "doc_id long, idx int, key string, is_start boolean")
    got = {}
    for r in paragraphs.rebuild_paragraphs(units, seq).orderBy("doc_id", "idx").collect():
        words = [w for w in r["text"].replace("# ", "#").split(" ")]
        got.setdefault(r["doc_id"], []).extend([True] + [False] * (len(words) - 1))
    assert got == {d: plain_rebuild(u, s) for d, (u, s) in enumerate(docs)}


def plain_stitch(kinds):
    """kinds: o open, l lower, h heading, s short or note, S long but passed over and open, p plain."""
    into, k = {}, 0
    while k < len(kinds):
        if kinds[k] in "oOS":
            ahead = [j for j in range(k + 1, len(kinds)) if kinds[j] not in "sS"]
            if ahead and kinds[ahead[0]] in "lO":
                into[ahead[0]] = k
                k = ahead[0]
        k += 1
    return into


def test_stitch_against_a_loop(spark):
    rng = random.Random(8)
    long = lambda t, end: f"{t} " + "word " * 25 + end
    make = {"o": ("Open", "and"), "O": ("lower open", "and"), "l": ("lower", "end."), "p": ("Plain", "end."), "S": ("Figure", "and")}
    docs = [[rng.choice("oOOOlphsSS") for _ in range(rng.randint(1, 25))] for _ in range(150)]
    text = lambda k, i: f"# Head {chr(97 + i)}" if k == "h" else f"note {chr(97 + i)}" if k == "s" else long(*make[k]) + chr(97 + i) * 0
    rows = [(d, i, text(k, i)) for d, ks in enumerate(docs) for i, k in enumerate(ks)]
    got = {}
    for r in paragraphs.stitch_pages(spark.createDataFrame(rows, "doc_id long, idx int, text string")).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for d, ks in enumerate(docs):
        into, all_texts = plain_stitch(ks), [text(k, i) for i, k in enumerate(ks)]
        back = {i: j for j, i in into.items()}
        want = [f"{t} {all_texts[back[i]]}" if i in back else t for i, t in enumerate(all_texts) if i not in into]
        assert got[d] == want


def test_stitch(spark):
    a, b = "x" * 81 + " and it", "goes on to the end of this long block which is over eighty characters, for a test of it."
    made = ["Run 1", "Run 2", a, "> note", b, "Run 3", "12"]
    assert texts(paragraphs.stitch_pages(blocks(spark, made))) == [f"{a} {b}", "> note"]


def test_score_and_gate(spark):
    sizes = spark.createDataFrame([(1, 100, 100, 0), (2, 70, 100, 0), (3, 70, 100, 30), (4, 5, 0, 0)], "doc_id long, kept long, raw long, dropped long")
    ends = spark.createDataFrame([(1, 20, 0), (3, 10, 5)], "doc_id long, checked long, bad long")
    got = {r["doc_id"]: r for r in quality.gate(quality.score(sizes, ends)).collect()}
    assert [got[k]["gate_ok"] for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[3]["coverage"] == 1.0 and got[3]["truncated"] == 0.5 and got[4]["coverage"] == 0.0
    assert [r["gate_ok"] for r in quality.gate(quality.score(sizes, ends), force=True).orderBy("doc_id").collect()] == [True, False, True, False]


def plain_best(c):
    best = c[0]
    pen = lambda x: abs(1 - x[1]) + x[2]
    for x in c[1:]:
        better = x[3] if x[3] != best[3] else pen(x) < pen(best)
        if (x[4] and x[3]) if x[4] != best[4] else better:
            best = x
    return best[0]


def test_tournament_against_a_loop(spark):
    rng = random.Random(3)
    made = {d: [(k, rng.choice([0.9, 0.98, 1.0, 1.2]), rng.choice([0.0, 0.04, 0.2]), rng.random() < 0.5, rng.random() < 0.5) for k in range(3)] for d in range(80)}
    rows = spark.createDataFrame([(d, *x[:1], f"c{x[0]}", *x[1:]) for d, c in made.items() for x in c], "doc_id long, ord int, name string, coverage double, truncated double, ok boolean, keeps_tables boolean")
    assert {r["doc_id"]: r["ord"] for r in quality.tournament(rows).collect()} == {d: plain_best(c) for d, c in made.items()}
    best = quality.tournament(rows)
    other = best.select("doc_id", F.lit("old").alias("name"), F.lit(1.0).alias("coverage"), F.lit(0.0).alias("truncated"), F.lit(True).alias("ok"))
    assert all((r["name"] == "old") == (not o["ok"]) for r, o in zip(quality.with_fallback(best, other).orderBy("doc_id").collect(), best.orderBy("doc_id").collect(), strict=True))


def plain_chunks(lengths, most):
    ids, chunk, total, closed = [], 0, 0, True
    for n, sealed in lengths:
        if ids and (sealed or closed or total + n > most):
            chunk, total = chunk + 1, 0
        total, closed = total + n, sealed
        ids.append(chunk)
    return ids


def test_packing_and_splits(spark):
    atoms = lambda a: F.array(*[F.struct(F.lit(n).alias("length"), F.lit(s).alias("sealed")) for n, s in a])
    case = [(n, False) for n in (3000, 2000, 2500, 100)] + [(6000, True), (10, False)]
    assert spark.range(1).select(chunking.packed(atoms(case))).first()[0] == plain_chunks(case, 6000) == [0, 0, 1, 1, 2, 3]
    assert spark.range(1).select(chunking.hard_split(F.lit("aaaa\n\nbb\n\ncccccccccc\n\nd"), 8)).first()[0] == ["aaaa\n\nbb", "cccccccccc", "d"]
    docs = spark.createDataFrame([(1, "intro\n# A\ntext\n#### no\n## B\nmore")], "doc_id long, text string")
    sections = chunking.split_sections(docs)
    assert texts(sections) == ["intro\n", "# A\ntext\n#### no\n", "## B\nmore"]
    got = chunking.chunk_index(chunking.chunks(sections, 12)).orderBy("id").collect()
    assert [(r["id"], r["chars"], r["heading"]) for r in got] == [("001.md", 6, ""), ("002.md", 17, "# A"), ("003.md", 9, "## B")]


LINE = "doc_id long, pno int, line_no int, x0 double, x1 double, y0 double, y1 double, text string, size double, math double"


def line(pno, no, x, y, size, text, math=0.0, wide=0.5):
    return (1, pno, no, float(x), x + wide * size * len(text), float(y), float(y + size), text, float(size), math)


def two_columns():
    out = []
    for p in range(3):
        n = 0
        for x, y, s, t in [(48, 40, 9.8, f"{180 + p} A. Author"), (56, 100, 8.0, "The model is developed in this"), (48, 111, 8.0, "section. Firms rely on communi-"), (48, 122, 8.0, "cation among their units."),
                           (293, 80, 8.0, "This right column follows the"), (285, 91, 8.0, "left one in reading order."), (285, 620, 6.5, f"{p} See Nelson for a discussion"), (120, 750, 8.0, "This content downloaded on Tue")]:
            out.append(line(p, n, x, y, s, t if y in (40, 750) else t.replace("e", "e" + "abc"[p])))
            n += 1
    return out


def test_reading_order_and_flags(spark):
    lines = spark.createDataFrame(two_columns(), LINE)
    pages = spark.createDataFrame([(1, p, 530.0, 800.0) for p in range(3)], "doc_id long, pno int, width double, height double")
    ordered = layout.ordered_lines(lines, pages)
    rows = layout.line_flags(ordered).orderBy("seq").collect()
    assert not any("Author" in r["text"] or "downloaded" in r["text"] for r in rows)
    first = [r["text"] for r in rows if r["pno"] == 0]
    assert first[0].startswith("Thea") and first[-1].startswith("0 S") and rows[len(first) - 1]["is_note"]
    assert [r["is_start"] for r in rows if r["pno"] == 0][:3] == [True, False, False]
    assert {r["body_size"] for r in rows} == {8.0}


def test_lines_are_dealt_once_and_sorted_three_times(spark):
    lines = spark.createDataFrame(two_columns(), LINE)
    pages = spark.createDataFrame([(1, p, 530.0, 800.0) for p in range(3)], "doc_id long, pno int, width double, height double")
    flags = layout.line_flags(layout.ordered_lines(lines, pages), layout.READING)
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 5  # by normal form, by page and in reading order; two of the counts of lines by size
    assert "SortMergeJoin" not in plan
    key = lambda df: sorted((r["seq"], r["text"], r["is_start"], r["is_heading"]) for r in df.collect())
    assert key(flags) == key(layout.line_flags(layout.ordered_lines(lines, pages)))


def test_long_lines_that_repeat_and_lines_without_a_page(spark):
    head, far = "a" * 119, "1" * 300 + " " * 300 + "a" * 119 + " " * 900 + "7"  # one normal form
    made = [line(p, 0, 50, 100, 8, t) for p, t in enumerate([head, head, head, far])] + [line(p, 1, 50, 120, 8, "b" * 130) for p in range(4)] + [line(9, 0, 50, 100, 8, "no page")]
    pages = spark.createDataFrame([(1, p, 530.0, 800.0) for p in range(4)], "doc_id long, pno int, width double, height double")
    rows = layout.ordered_lines(spark.createDataFrame(made, LINE), pages).collect()
    assert [r["text"] for r in sorted(rows, key=lambda r: r["seq"])] == ["b" * 130] * 4


def test_body_measures_are_sizes_and_band(spark):
    rng = random.Random(3)
    made = [(d, rng.choice([0.0, 6.5, 8.0, 8.04, 8.6, 9.1, 7.4])) for d in range(40) for _ in range(rng.randint(1, 12))]
    lines = spark.createDataFrame(made, "doc_id long, size double")
    key = lambda df: sorted((r["doc_id"], r["body_size"], r["lo"], r["hi"]) for r in df.collect())
    assert key(layout.body_measures(lines)) == key(layout.body_band(lines, layout.body_sizes(lines)))
    got = {r["doc_id"]: r for r in layout.body_measures(lines).collect()}
    for d, r in got.items():
        sizes = sorted(s for k, s in made if k == d and s > 0)
        b = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
        tenths = [float(round(Decimal(str(s)), 1)) for s in sizes]
        common = {s for s in tenths if tenths.count(s) / len(tenths) >= 0.2}
        assert r["body_size"] == pytest.approx(b)
        assert r["hi"] == pytest.approx(max([b * 1.12, *(s + 0.05 for s in common if b < s <= b * 1.2)]))
        assert r["lo"] == pytest.approx(min([b * 0.9, *(s - 0.05 for s in common if b * 0.8 <= s < b)]))


def plain_headings(rows):
    out, before, ended = [], False, True
    for k, (base, size, ends) in enumerate(rows):
        out.append(base and (size >= 1.25 or (size >= 1.08 and (k == 0 or before or ended))))
        before, ended = out[-1], ends
    return out


def test_headings_against_a_loop(spark):
    rng = random.Random(9)
    made = [[(rng.random() < 0.7, rng.choice([1.0, 1.1, 1.3]), rng.random() < 0.3) for _ in range(12)] for _ in range(40)]
    rows = [
        (d, 0, k, k, 0.0, 50.0, 0.0, 200.0, ("Heading line" if base else "x?1 ?? 2 ! ?") + ("." if ends else " a"), 10 * size, 10.0, 10.5, 0.0, 100.0)
        for d, m in enumerate(made) for k, (base, size, ends) in enumerate(m)
    ]
    df = spark.createDataFrame(rows, "doc_id long, pno int, line_no int, seq int, x0 double, x1 double, edge double, right double, text string, size double, body_size double, hi double, y0 double, height double")
    got = {}
    for r in layout.line_flags(df).orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append(r["is_heading"])
    want = {d: plain_headings([(b and s > 1.05, s, e) for b, s, e in m]) for d, m in enumerate(made)}
    assert got == want


def test_regions(spark):
    lines = spark.createDataFrame(
        [line(0, 0, 60, 100, 12, "prose " * 14), line(0, 1, 200, 130, 12, "˙At = θSη", 0.9), line(0, 2, 200, 300, 12, ".", 1.0)], LINE
    )
    sized = lines.withColumn("width", F.lit(560.0)).withColumn("height", F.lit(800.0))
    assert [r["text"] for r in regions.equation_regions(sized.where(regions.is_display_equation(F.lit(470.0)))).collect()] == ["˙At = θSη"]
    box = spark.createDataFrame([(1, 0, 190.0, 120.0, 300.0, 140.0)], "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double")
    assert [r["line_no"] for r in regions.covered(lines, box).collect()] == [1]
    assert sorted(r["line_no"] for r in regions.outside(lines, box).collect()) == [0, 2]
    anchors = regions.anchor_above(spark.createDataFrame([(7, 1, 0, 150.0, 0.0, 560.0)], "t_id int, doc_id long, pno int, y0 double, left double, right double"), lines)
    assert anchors.first()["anchor"] == "˙At = θSη"
    images = spark.createDataFrame([(1, 0, 5, 60.0, 300.0, 260.0, 450.0), (1, 0, 6, 300.0, 300.0, 340.0, 340.0), (1, 0, 7, 0.0, 0.0, 300.0, 200.0), (1, 1, 7, 0.0, 0.0, 300.0, 200.0)], "doc_id long, pno int, xref int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, p, 530.0, 800.0) for p in range(2)], "doc_id long, pno int, width double, height double")
    assert [r["xref"] for r in regions.pick_images(images, pages).collect()] == [5]


BOX = "x0 double, y0 double, x1 double, y1 double"


class Page:
    """A made page of two columns, and its regions by the rules, rectangle by rectangle."""

    def __init__(self, rng):
        kinds = ["Plain words of a paragraph go on here", "short", "Figure 1. A caption", "Table 2: A caption", "a = b + c (3)", "x", "1.0 2.0 3.5 rows of it"]
        weights = [9, 3, 1.2, 0.8, 2, 0.5, 2]
        self.lines, y = [], {0: 40.0, 1: 40.0}
        for k in range(60):
            side = rng.randint(0, 1)
            text = rng.choices(kinds, weights)[0]
            size = rng.choice([8.0, 8.0, 8.0, 8.0, 6.5, 10.0])
            x0 = 40 + 245 * side + rng.choice([0, 0, 0, 8, 60])
            wide = 400 if rng.random() < 0.03 else min(205.0, rng.choice([0.6, 0.75, 1.0]) * size * len(text))
            math = rng.choice([0.5, 0.9]) if "=" in text or text == "x" else rng.choice([0.0, 0.0, 0.1])
            self.lines.append((k, x0, x0 + wide, y[side], y[side] + size, text, size, math))
            y[side] += rng.choice([11.0, 11.0, 12.0, 26.0])
        self.tables = [(rng.uniform(40, 300), t := rng.uniform(40, 300), rng.uniform(310, 480), t + rng.uniform(20, 60)) for _ in range(rng.randint(0, 1))]
        self.graphics = [(g := rng.uniform(20, 300), t := rng.uniform(30, 500), g + rng.uniform(-5, 250), t + rng.uniform(0, 150)) for _ in range(rng.randint(0, 3))]

    width, height, lo, hi, body = 530.0, 800.0, 7.2, 8.96, 8.0

    def columns(self, x0, x1):
        every = [(a, b) for _, a, b, *_ in self.lines]
        side = [(a, b) for a, b in every if (a + b < self.width) == (x0 + x1 < self.width)]
        use = side if side and x1 - x0 <= 0.6 * self.width else every
        return min(a for a, _ in use), max(b for _, b in use)

    def prose(self, line, column):
        _, x0, x1, _, _, text, size, _ = line
        numbers = sum(set(w) <= set("0123456789.,%$/[]()·~-") for w in text.split())
        return self.lo <= size <= self.hi and x1 - x0 >= 0.4 * max(column, 1.0) and numbers < 3

    @staticmethod
    def holds(box, line):
        return box[0] <= (line[1] + line[2]) / 2 <= box[2] and box[1] <= line[3] <= box[3]

    def edge(self, cap, up, column):
        _, x0, x1, y0, y1, *_ = cap
        reach = [l for l in self.lines if l[2] >= x0 - 30 and l[1] <= x1 + 30]
        if up:
            reach = sorted((l for l in reach if max(y0 - 0.6 * self.height, 0) <= l[3] < y0 - 2), key=lambda l: (-l[3], l[0]))
        else:
            reach = sorted((l for l in reach if y1 + 1 < l[3] <= min(y1 + 0.85 * self.height, self.height)), key=lambda l: (l[3], l[0]))
        flags = "".join("p" if self.prose(l, column) else "-" for l in reach)
        before = flags.split("ppp")[0].rstrip("p")
        return (y0 if up else y1) if not before else reach[len(before) - 1][3] - 2 if up else reach[len(before) - 1][4]

    def grown(self, box):
        wide, flat = list(box), self.width * self.height * 0.6
        ink = [g for g in self.graphics if g[2] > g[0] and g[3] > g[1] and (g[2] - g[0]) * (g[3] - g[1]) <= flat and g[3] > box[1] and g[1] < box[3]]
        if ink:
            wide = [min(wide[0], min(g[0] for g in ink) - 14), min(wide[1], min(g[1] for g in ink) - 2), max(wide[2], max(g[2] for g in ink) + 14), max(wide[3], max(g[3] for g in ink) + 2)]
        labels = [l for l in self.lines if box[1] <= l[3] <= box[3] and not self.prose(l, box[2] - box[0])]
        if labels:
            a, b = box[0], box[2]
            for _ in labels:  # each pass adds one at least, or none ever will
                near = [l for l in labels if l[2] >= a - 40 and l[1] <= b + 40]
                a, b = min([a, *(l[1] for l in near)]), max([b, *(l[2] for l in near)])
            wide[0], wide[2] = min(wide[0], a - 14), max(wide[2], b + 14)
        wide = (max(wide[0], 0.0), max(wide[1], 0.0), min(wide[2], self.width), min(wide[3], self.height))
        swallowed = any(self.prose(l, box[2] - box[0]) and self.holds(wide, l) and not self.holds(box, l) for l in self.lines)
        return box if swallowed else wide

    def enough(self, text):
        return len("".join(text.split())) >= 6 and ("=" in text or text.rstrip().endswith("(3)"))

    def anchor(self, box, without=()):
        left, right = self.columns(box[0], box[2])
        above = [l for l in self.lines if l[0] not in without and l[4] <= box[1] + 1 and left - 2 <= (l[1] + l[2]) / 2 <= right + 2]
        return max(above, key=lambda l: (l[4], -l[0]))[5] if above else ""

    def plan(self):
        out = []
        for x0, y0, x1, y1 in self.tables:
            box = (x0 - 4, y0 - 4, x1 + 4, y1 + 1)
            own = [l for l in self.lines if self.holds(box, l)]
            n = sum(len(l[5]) for l in own)
            math = n and sum(len(l[5]) * l[7] for l in own) / n >= 0.5 and self.enough(" ".join(l[5] for l in own))
            out.append((y0, 0, x0, "equation" if math else "table", box, None, self.anchor(box) if math else None))
        for cap in self.lines:
            _, x0, x1, y0, y1, text, size, _ = cap
            if not text.startswith(("Figure", "Table")):
                continue
            left, right = self.columns(x0, x1)
            tops = [l[3] for l in self.lines if l[3] < y0 - 2 and l[2] >= x0 - 30 and l[1] <= x1 + 30]
            if not (size <= 0.95 * self.body or not tops or y0 - max(tops) >= 15 or x0 - left >= 0.15 * (right - left)):
                continue
            top, bottom = (self.edge(cap, up, right - left) for up in (True, False))
            boxes = [(top, y0 - 2) if y0 - top >= 40 else None, (y1 + 1, bottom + 2) if bottom - y1 >= 40 else None]
            found = [b for b in (boxes[::-1] if text.startswith("Table") else boxes) if b]
            if found:
                box = self.grown((left - 14, found[0][0], right + 14, found[0][1]))
                out.append((box[1], 1, cap[0], "figure", box, text, None))
        eqs = []
        for l in self.lines:
            left, right = self.columns(l[1], l[2])
            if l[7] >= 0.3 and l[2] - l[1] < 0.7 * (right - left) and not any(self.holds(r[4], l) for r in out):
                eqs.append(l)
        groups = []
        for l in sorted(eqs, key=lambda l: (l[3], l[0])):
            if groups and l[3] - groups[-1][-1][4] <= max(6.0, 1.6 * (groups[-1][-1][4] - groups[-1][-1][3])):
                groups[-1].append(l)
            else:
                groups.append([l])
        for g in groups:
            if self.enough(" ".join(l[5] for l in g)):
                y = min(l[3] for l in g)
                box = (min(l[1] for l in g) - 14, y - 4, max(l[2] for l in g) + 14, max(l[4] for l in g) + 4)
                out.append((y, 2, y, "equation", box, None, self.anchor(box, {l[0] for l in eqs})))
        out.sort(key=lambda r: r[:3])
        return [(k, f"{'eq' if r[3] == 'equation' else 'fig'}-p001-{k:02d}.png", r[3], tuple(round(v, 6) for v in r[4]), r[5], r[6]) for k, r in enumerate(out, 1)]


def test_plan_against_loops(spark):
    rng = random.Random(11)
    made = [Page(rng) for _ in range(60)]
    lines = spark.createDataFrame([(d, 0, k, float(x0), float(x1), y0, y1, t, s, m) for d, p in enumerate(made) for k, x0, x1, y0, y1, t, s, m in p.lines], LINE)
    pages = spark.createDataFrame([(d, 0, 530.0, 800.0) for d in range(60)], "doc_id long, pno int, width double, height double")
    boxes = lambda of: spark.createDataFrame([(d, 0, *b) for d, p in enumerate(made) for b in of(p)], f"doc_id long, pno int, {BOX}")
    got = {}
    for r in regions.plan(lines, pages, boxes(lambda p: p.tables), boxes(lambda p: p.graphics)).orderBy("doc_id", "n").collect():
        assert r["link"] == f"![](images/{r['name']})"
        got.setdefault(r["doc_id"], []).append((r["n"], r["name"], r["kind"], tuple(round(r[c], 6) for c in ("x0", "y0", "x1", "y1")), r["cap_text"], r["anchor"]))
    band = layout.body_band(lines, layout.body_sizes(lines)).collect()
    usual = {r["doc_id"] for r in band if abs(r["lo"] - 7.2) < 1e-9 and abs(r["hi"] - 8.96) < 1e-9 and r["body_size"] == 8.0}
    want = {d: p.plan() for d, p in enumerate(made)}
    assert len(usual) > 40 and {k for w in want.values() for _, _, k, *_ in w} == {"table", "figure", "equation"}
    for d in usual:
        assert got.get(d, []) == want[d]


def test_links(spark):
    paras = blocks(spark, ["The reduced form is here", "Figure one shows the diagram", "end"])
    eq = spark.createDataFrame([(1, 0, "equation", "reduced-form", "E0"), (1, 1, "figure", "end", "F"), (1, 2, "equation", "absent", "E2")], "doc_id long, n long, kind string, anchor string, link string")
    assert texts(links.link_equations(paras, eq)) == ["The reduced form is here", "E0", "Figure one shows the diagram", "end", "E2"]
    cap = spark.createDataFrame([(1, 0, "Figure one shows the diagram of", "C0"), (1, 1, "Not there at all, really", "C1")], "doc_id long, n long, cap_text string, link string")
    assert texts(links.link_captions(paras, cap)) == ["The reduced form is here", "C0", "Figure one shows the diagram", "end", "C1"]
    shown = spark.createDataFrame([(1, 0, 1, "P0"), (1, 5, 1, "P5")], "doc_id long, pno int, n int, link string")
    last = spark.createDataFrame([(1, 0, "reducedform")], "doc_id long, pno int, last_key string")
    assert texts(links.link_pages(paras, shown, last)) == ["The reduced form is here", "P0", "Figure one shows the diagram", "end", "P5"]


def test_verify_and_final(spark):
    good = ("In 1993 (Berryman, 1983)\n\n# H\n\n| a |", "1993년 가나다라마바사 (Berryman, 1983)\n\n# 머리\n\n| 가 |")
    bad = ("In 1993 and 7 ![f](images/a.png)", "English only\n\n> " + "y" * 50)
    pairs = spark.createDataFrame([(1, "001", *good), (1, "002", *bad), (1, "003", "x", None)], "doc_id long, id string, source string, translation string")
    got = {r["id"]: r for r in checks.verify(pairs).collect()}
    assert got["001"]["ok"] and got["003"]["problems"] == ["no translation"]
    said = "; ".join(got["002"]["problems"])
    for part in ("missing image link images/a.png", "missing number 1993", "paragraph count 1→2", "untranslated footnote", "hangul ratio 0.00"):
        assert part in said
    assert got["002"]["warnings"] == ["7"]
    work = spark.createDataFrame([(1, "a 1993", "> **각주 1** 한글 각주입니다. 1993", "<img src=\"x\">", [], 2, 2, 1, 0.99, 0.01, "columns", 2), (2, "a", None, None, [], None, None, None, None, None, None, None)], "doc_id long, source string, ko string, html string, files array<string>, chunks int, translated int, reviewed int, coverage double, truncated double, extractor string, figures int")
    rows = {(r["doc_id"], r["item"]): r["ok"] for r in checks.final_check(work).collect()}
    assert rows[1, "untranslated footnotes"] and rows[1, "missing years"] and not rows[1, "html images"] and rows[1, "chunks without review"]
    assert {k: v for k, v in rows.items() if k[0] == 2} == {(2, "translation"): False}
    assert "FAIL" in checks.check_report(checks.final_check(work)).where("doc_id = 2").first()["report"]


def test_html(spark):
    pages = spark.createDataFrame([(1, "<article><h1>A &amp; B</h1><p>one<br>two</p><ul><li>x</li></ul></article>")], "page_id long, html string")
    assert [r["text"] for r in html.html_blocks(pages).orderBy("idx").collect()] == ["# A & B", "one\ntwo", "- x"]
    docs = spark.createDataFrame([(1, "# T\n\ntext ![a](i.png)\n\n> q")], "doc_id long, text string")
    made = html.render(docs)
    assert "<title>T</title>" in made.first()["html"] and '<img alt="a" src="i.png">' in made.first()["html"]
    rich = "| a | b |\n|---|:-:|\n| 1 | **2** |\n| 3 | <4> |\n\n- one\n- *two*\n\n1. x\n2. y\n\n---\n\n```py\na < b\n```\n\nsee [it](u.html) and `c_d` a_b_c\n\n| lone | row |"
    body = html.render(spark.createDataFrame([(1, rich)], "doc_id long, text string")).first()["html"].split("<body>\n")[1].split("\n</body>")[0]
    assert body.split("\n") == [
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><strong>2</strong></td></tr><tr><td>3</td><td>&lt;4&gt;</td></tr></table>",
        "<ul><li>one</li><li><em>two</em></li></ul>", "<ol><li>x</li><li>y</li></ol>", "<hr>", "<pre><code>a &lt; b</code></pre>",
        '<p>see <a href="u.html">it</a> and <code>c_d</code> a_b_c</p>', "<table><tr><td>lone</td><td>row</td></tr></table>",
    ]
    images = spark.createDataFrame([(1, "i.png", "image/png", bytearray(b"abc"))], "doc_id long, path string, mime string, content binary")
    assert 'src="data:image/png;base64,YWJj"' in html.embed_images(made, images).first()["html"]


def test_status(spark):
    fields = "stem string, html boolean, running boolean, known boolean, source boolean, indexed boolean, chunks int, translated int, reviewed int, glossary boolean"
    rows = [("a", True, False, True, True, True, 3, 3, 3, True), ("b", False, True, True, False, False, None, 0, 0, False), ("c", False, True, True, True, True, 4, 2, 0, False), ("d", False, False, True, True, True, 4, 2, 0, False), ("e", False, False, False, False, False, None, 0, 0, False), ("f", False, True, True, True, True, 4, 4, 2, True)]
    got = {r["stem"]: (r["status"], r["pct"]) for r in status.job_status(spark.createDataFrame(rows, fields)).collect()}
    assert got == {"a": ("done", 100), "b": ("running", 4), "c": ("running", 47), "d": ("failed", 0), "e": ("uploaded", 0), "f": ("running", 82)}


def test_streaming(spark, tmp_path):
    from foliant.streaming import files

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(k, f"text {k}\n\nmore") for k in range(5)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = files.arriving(spark, str(tmp_path / "in"), "doc_id long, text string")
    run = files.process(stream, lambda docs: paragraphs.explode_units(docs), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_files(spark, tmp_path):
    from foliant.sources import tables

    for name in ("a 1.pdf", "b.DOCX", "c.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r["stem"] for r in tables.list_inputs(spark, str(tmp_path)).collect()) == ["a_1", "b"]
    assert tables.count_files(spark, str(tmp_path), "*.txt") == 1


def test_report_rounds_as_c_does(spark):
    values = [0.0625, 0.1875, 0.8125, 0.8925, 0.0005, 0.0015, 0.0025, 0.9995, 0.99949999, 1.0005, 0.0, 1.0, 25.0625, 0.3, 2 / 3, *[k / 2000 for k in range(1, 2100, 2)]]
    rows = spark.createDataFrame([(k, v, v, False) for k, v in enumerate(values)], "doc_id long, coverage double, truncated double, ok boolean")
    bad = spark.createDataFrame([(0, 1, "x")], "doc_id long, n long, head string")
    got = {r["doc_id"]: r["report"].split("\n")[2] for r in quality.report(rows, bad).collect()}
    assert got == {k: f"coverage {v:.3f}, truncated {v:.3f}" for k, v in enumerate(values)}


def test_rebuilding_finds_the_lines_once(spark):
    units = blocks(spark, ["First line", "goes on", "Next"])
    lines = spark.createDataFrame([(1, 0, "firstline", True), (1, 1, "goeson", False), (1, 2, "next", True)], "doc_id long, idx int, key string, is_start boolean")
    made = paragraphs.rebuild_paragraphs(units, lines)
    assert any("/sequence-" in f for f in made.inputFiles())
    assert texts(made) == ["First line goes on", "Next"]


def test_long_paragraphs_join_by_their_ends(spark):
    parts = ["co-", "-", "op", "x-\n", "y", "one - ", "-", "two-", "three"]
    folded = ""
    for p in parts:  # the whole text so far is looked at, as before
        cut = re.search(r"\w-(?=\n?\Z)", folded)
        folded = p if folded == "" else folded[:-1] + p if cut else folded + " " + p
    rows = spark.createDataFrame([(parts,)], "p array<string>")
    assert rows.select(T.joined(F.col("p"))).first()[0] == folded


@pytest.mark.parametrize("of", ["above", "below", "labels"])
def test_pairs_of_lines_stay_dealt_by_page(spark, capsys, of):
    lines = spark.createDataFrame([(1, 0, k, "a word", 8.0, 10.0, 200.0, 20.0 * k, 20.0 * k + 8) for k in range(6)], "doc_id long, pno int, line_no int, text string, size double, x0 double, x1 double, y0 double, y1 double")
    seeds = lines.withColumns({"t_id": F.struct("doc_id", "line_no"), "lo": F.lit(1.0), "hi": F.lit(2.0), "height": F.lit(800.0), "left": F.lit(10.0), "right": F.lit(200.0)})
    made = regions.label_growth(seeds, lines) if of == "labels" else regions.region_edge(seeds, lines, of == "above")
    assert made.count() == 6
    capsys.readouterr()
    made.explain()
    assert "hashpartitioning(t_id" not in capsys.readouterr().out


def test_a_plan_tells_rows_of_numbers_once(spark, monkeypatch):
    calls, tell = [], T.is_table_row
    monkeypatch.setattr(T, "is_table_row", lambda c: calls.append(c) or tell(c))
    lines = spark.createDataFrame([line(0, 0, 60, 100, 8, "1 2 3 4 5 6 7 8"), line(0, 1, 60, 130, 8, "words " * 8), line(0, 2, 60, 200, 6, "Figure 1. A")], LINE)
    pages = spark.createDataFrame([(1, 0, 530.0, 800.0)], "doc_id long, pno int, width double, height double")
    assert [r["kind"] for r in regions.plan(lines, pages).collect()] == ["figure"]
    assert len(calls) == 1
