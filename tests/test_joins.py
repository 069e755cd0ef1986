"""Joins inside a document: how many pairs they make, and that none is lost."""

import random

from pyspark.sql import functions as F

from foliant.operators import containment, links, regions

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(3000)]


def some(r, n):
    return "".join(r.choice(WORDS) for _ in range(n))


def test_pieces_meet_few_texts(spark):
    r = random.Random(1)
    texts = [some(r, 12) for _ in range(5000)]
    pieces = []
    for k in range(500):
        t = r.choice(texts)
        at = r.randint(0, len(t) - 20)
        pieces.append(t[at : at + r.choice([15, 20, 30])])
    pieces += ["absent" + "z" * 20, texts[7][:9], texts[9][3:7], "é" * 16]
    held = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, pieces[0])], "doc_id long, idx int, text string")
    asked = spark.createDataFrame([(1, k, p) for k, p in enumerate(pieces)] + [(3, 0, "no document")], "doc_id long, n long, piece string")
    pairs = containment.candidates(held, asked.where("length(piece) >= 15"))
    assert pairs.count() <= 8 * len(pieces)  # of 2.5 million
    got = {(x["doc_id"], x["n"]): x["at"] for x in containment.first_holding(held, asked).collect()}
    want = {(1, k): next((i for i, t in enumerate(texts) if p in t), None) for k, p in enumerate(pieces)}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_pieces_of_all_lengths(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", None]
    pieces = ["".join(r.choice("ab") for _ in range(n)) for n in range(1, 25) for _ in range(4)] + ["", None]
    held = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, idx int, text string")
    asked = spark.createDataFrame([(1, k, p) for k, p in enumerate(pieces)], "doc_id long, n long, piece string")
    got = {x["n"]: x["at"] for x in containment.first_holding(held, asked).collect()}
    want = {k: next((i for i, t in enumerate(texts) if t is not None and p in t), None) for k, p in enumerate(pieces) if p}
    assert got == {k: v for k, v in want.items() if v is not None}


def loop_captions(paras, captions):
    """captions: (n, text, link), in order of n. The place of each link."""
    key = lambda t: "".join(c for c in t.lower() if c.isalnum() or c == "_")[:40]
    last = {}
    for n, t, link in captions:
        last[key(t)] = (last.get(key(t), (n,))[0], link)
    free, at = sorted((n, c, link) for c, (n, link) in last.items() if c), {}
    for idx, t in enumerate(paras):
        for n, c, link in free:
            if n not in at and key(t).startswith(c[:20]):
                at[n] = idx
                break
    return {link: at.get(n) for n, _, link in free}


def test_captions_against_a_loop(spark):
    r = random.Random(6)
    heads = ["Figure 1", "Figure 10", "Figure 1. A long caption of this", "Figure 1. A long caption of that", "Table 2: some numbers of the year", "Fig", "é 3"]
    paras = [r.choice(heads) + " " + r.choice(["", "and more text", "x"]) if r.random() < 0.5 else some(r, 5) for _ in range(5000)]
    captions = [(k, r.choice(heads) + f" {r.randint(0, 60)}" * r.randint(0, 1) + " tail" * r.randint(0, 2), f"L{k}") for k in range(300)]
    blocks = spark.createDataFrame([(1, k, t) for k, t in enumerate(paras)], "doc_id long, idx int, text string")
    table = spark.createDataFrame([(1, n, t, link) for n, t, link in captions], "doc_id long, n long, cap_text string, link string")
    rows = [x["text"] for x in links.link_captions(blocks, table).orderBy("idx").collect()]
    want, before, seen = loop_captions(paras, captions), {}, 0
    held = []
    for t in rows:
        if t in want:
            held.append(t)
        else:
            for link in held:
                before[link] = seen
            held = []
            seen += 1
    assert seen == len(paras) and before == {k: v for k, v in want.items() if v is not None} and set(held) == {k for k, v in want.items() if v is None}


def test_captions_of_one_prefix_need_no_fold(spark):
    """5,000 paragraphs with one beginning take the links in order."""
    blocks = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("Figure 7: the same words again "), F.col("id").cast("string")).alias("text"))
    table = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("n"), F.concat(F.lit("Figure 7: the same words again "), F.col("id").cast("string")).alias("cap_text"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("link"))
    rows = [x["text"] for x in links.link_captions(blocks, table).orderBy("idx").collect()]
    assert [t for t in rows[:4000:2]] == [f"L{k}" for k in range(2000)] and len(rows) == 7000


def test_many_regions_of_a_page_stay_in_page_order(spark):
    paras = spark.createDataFrame([(1, 0, "only paragraph")], "doc_id long, idx int, text string")
    shown = spark.createDataFrame([(1, p, 1, n, f"r{p}-{n}") for p in range(2) for n in range(1200)] + [(1, 1, 0, 5, "image")], "doc_id long, pno int, kind int, n long, link string")
    last = spark.createDataFrame([(1, 0, "nowhere")], "doc_id long, pno int, last_key string")
    rows = [x["text"] for x in links.link_pages(paras, shown, last).orderBy("idx").collect()]
    assert rows == ["only paragraph", *[f"r0-{n}" for n in range(1200)], "image", *[f"r1-{n}" for n in range(1200)]]


def test_points_meet_regions_of_their_cell(spark):
    r = random.Random(8)
    lines = [(1, 0, k, x := r.uniform(0, 500), x + 30, r.uniform(0, 800)) for k in range(300)]
    boxes = [(1, 0, x := r.uniform(-10, 500), y := r.uniform(-10, 790), x + r.choice([5, 20, 40]), y + r.choice([5, 20])) for _ in range(200)]
    boxes += [(1, 0, -1e9, -1e9, 1e9, 1e9), (1, 0, 50.0, 50.0, 10.0, 60.0), (1, 0, None, 0.0, 1.0, 1.0), (2, 0, 0.0, 0.0, 9e3, 9e3)]
    table = spark.createDataFrame(lines, "doc_id long, pno int, line_no int, x0 double, x1 double, y0 double")
    for some_boxes, most in ((boxes[:200], 8), (boxes, 210)):
        held = spark.createDataFrame(some_boxes, "doc_id long, pno int, x0 double, y0 double, x1 double, y1 double")
        placed, posted = regions._in_cells(table, held)
        assert placed.join(posted, F.expr(regions.SHARED_CELL)).count() <= most * len(lines) and posted.count() <= 12 * len(some_boxes)
        inside = lambda p, b: b[2] is not None and b[:2] == p[:2] and b[2] <= (p[3] + p[4]) / 2 <= b[4] and b[3] <= p[5] <= b[5]
        want = sorted(p[2] for p in lines for b in some_boxes if inside(p, b))
        assert sorted(x["line_no"] for x in regions.covering(table, held).collect()) == want
        assert {x["line_no"] for x in regions.outside(table, held).collect()} == set(range(300)) - set(want) and {x["line_no"] for x in regions.covered(table, held).collect()} == set(want)


def test_anchors_against_a_loop(spark):
    r = random.Random(9)
    lines = [(1, p, k, x := r.choice([10.0, 300.0]), x + 100, y := float(r.randint(0, 40) * 10), y + 9, f"t{k}") for p in range(2) for k in range(60)]
    table = spark.createDataFrame(lines, "doc_id long, pno int, line_no int, x0 double, x1 double, y0 double, y1 double, text string")
    spans = [(0.0, 200.0), (250.0, 500.0), (0.0, 500.0), (900.0, 901.0)]
    targets = [(k, 1, r.randint(0, 2), float(r.randint(0, 40) * 10 + r.choice([0, -1, 5])), *r.choice(spans)) for k in range(80)]
    asked = spark.createDataFrame(targets, "t_id long, doc_id long, pno int, y0 double, left double, right double")
    got = {x["t_id"]: x["anchor"] for x in regions.anchor_above(asked, table).collect()}
    for k, _, p, y0, left, right in targets:
        above = [(l[6], -l[2], l[7]) for l in lines if l[1] == p and l[6] <= y0 + 1 and left - 2 <= (l[3] + l[4]) / 2 <= right + 2]
        assert got[k] == (max(above)[2] if above else "")
