"""Figure, table and equation regions of pages.

regions: doc_id, pno, x0, y0, x1, y1 and what each step adds. Every join has the page in its keys, so a rectangle meets
the lines of its own page only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant import config as C
from foliant.functions import text as T
from foliant.operators import layout
from foliant.shared import cut, dealt

PAGE = ["doc_id", "pno"]


def inside(x0: Column, x1: Column, y0: Column, region: str = "r_") -> Column:
    """Whether a line's middle and top lie in a region, borders included."""
    middle = (x0 + x1) / 2
    return middle.between(F.col(f"{region}x0"), F.col(f"{region}x1")) & y0.between(F.col(f"{region}y0"), F.col(f"{region}y1"))


def _named(regions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return regions.select(*PAGE, *keep, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])


#: Points; a page's grid is no finer.
CELL = 40.0


def _grid(regions: DataFrame) -> DataFrame:
    """The side of each page's cells (r_doc_id, r_pno, side): so large that its regions cover few cells each on average,
    however large some of them are."""
    w, h = F.col("r_x1") - F.col("r_x0"), F.col("r_y1") - F.col("r_y0")
    return regions.groupBy("r_doc_id", "r_pno").agg(F.greatest(F.lit(CELL), F.sqrt(F.avg(w * h)), F.avg(w + h) / 4).alias("side"))


def _in_cells(rows: DataFrame, regions: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """rows with the cell of their page's grid that their point lies in (__cx, __cy; null on pages without regions), and the
    regions posted under the cells that they cover (r_cx, r_cy). A point is looked up in one cell, so no pair comes twice."""
    r = _named(regions, keep).withColumnsRenamed({"doc_id": "r_doc_id", "pno": "r_pno"}).where("r_x1 >= r_x0 AND r_y1 >= r_y0")
    grid = _grid(r)
    cell = lambda x: F.floor(x / F.col("side"))
    posted = r.join(dealt(grid), ["r_doc_id", "r_pno"])
    posted = posted.withColumn("r_cx", F.explode(F.sequence(cell(F.col("r_x0")), cell(F.col("r_x1"))))).withColumn("r_cy", F.explode(F.sequence(cell(F.col("r_y0")), cell(F.col("r_y1"))))).drop("side")
    placed = rows.join(dealt(grid), (F.col("doc_id") == F.col("r_doc_id")) & (F.col("pno") == F.col("r_pno")), "left").drop("r_doc_id", "r_pno")
    return placed.withColumn("__cx", cell((F.col("x0") + F.col("x1")) / 2)).withColumn("__cy", cell(F.col("y0"))).drop("side"), posted


SHARED_CELL = "doc_id = r_doc_id AND pno = r_pno AND __cx = r_cx AND __cy = r_cy"


def _covered(rows: DataFrame, regions: DataFrame, how: str, keep: tuple[str, ...] = ()) -> DataFrame:
    placed, posted = _in_cells(rows, regions, keep)
    return placed.join(dealt(posted), F.expr(SHARED_CELL) & inside(F.col("x0"), F.col("x1"), F.col("y0")), how).drop("__cx", "__cy")


def covering(rows: DataFrame, regions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each of rows with each region of its page that it lies in: the columns of rows, the region's columns keep, and its box
    as r_x0 to r_y1."""
    return _covered(rows, regions, "inner", keep).drop("r_doc_id", "r_pno", "r_cx", "r_cy")


def covered(rows: DataFrame, regions: DataFrame) -> DataFrame:
    return _covered(rows, regions, "left_semi")


def outside(rows: DataFrame, regions: DataFrame) -> DataFrame:
    return _covered(rows, regions, "left_anti")


def region_chars(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Characters that regions take out of each document's text."""
    return covered(lines, regions).groupBy("doc_id").agg(F.sum(T.norm_len(F.col("text"))).alias("chars"))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two spans come within the slack of each other, borders included."""
    return (a1 >= b0 - C.OVERLAP_SLACK) & (a0 <= b1 + C.OVERLAP_SLACK)


def column_bounds(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """targets (page, x0, x1, width) with left and right of the column that each stands in: of all lines of its page if it is
    wide or its side has none, else of those on its side. A page's bounds are one row."""
    left = lambda a, b: (a + b) / 2 < F.col("width") / 2
    sided = lines.select(*PAGE, "x0", "x1").join(dealt(targets.select(*PAGE, "width").distinct()), PAGE).withColumn("on_left", left(F.col("x0"), F.col("x1")))
    own = lambda c, when: F.when(when, F.col(c))
    sides = {"p": F.lit(True), "l": F.col("on_left"), "r": ~F.col("on_left")}
    bounds = sided.groupBy(*PAGE).agg(*[f(own(c, when)).alias(f"{name}_{c}") for name, when in sides.items() for f, c in ((F.min, "x0"), (F.max, "x1"))])
    wide = (F.col("x1") - F.col("x0")) > F.col("width") * C.FULL_WIDTH
    side = lambda c: F.when(wide, F.col(f"p_{c}")).otherwise(F.coalesce(F.when(left(F.col("x0"), F.col("x1")), F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")), F.col(f"p_{c}")))
    return targets.join(dealt(bounds), PAGE).select(*targets.columns, side("x0").alias("left"), side("x1").alias("right"))


def _told(lines: DataFrame, *columns: str | Column) -> DataFrame:
    """The page and the columns of lines with tabular, whether each is a row of numbers, in place of its text: told once a
    line, before lines meet what stands on their page, and not once for every such pair; not at all, if lines have it."""
    tabular = F.col("tabular") if "tabular" in lines.columns else T.is_table_row(F.col("text"))
    return lines.select(*PAGE, *columns, tabular.alias("tabular"))


def is_prose(lo: Column, hi: Column, column_width: Column, x0: Column | None = None, x1: Column | None = None) -> Column:
    """Whether a line (size, tabular, x0, x1) is one of a paragraph: of body size, wide, and no row of numbers."""
    width = (F.col("x1") if x1 is None else x1) - (F.col("x0") if x0 is None else x0)
    return (hi > 0) & F.col("size").between(lo, hi) & (width >= F.greatest(column_width, F.lit(1.0)) * C.WIDE_RATIO) & ~F.col("tabular")


def captions(lines: DataFrame) -> DataFrame:
    """Lines (with t_id, left, right, body_size) that are captions: they look like one, and are small, or begin well below
    the line above, or are indented."""
    above = lines.select(*PAGE, F.col("x0").alias("a_x0"), F.col("x1").alias("a_x1"), F.col("y0").alias("a_y0"))
    like = lines.where(T.is_caption_text(F.col("text")))
    near = overlaps(F.col("a_x0"), F.col("a_x1"), F.col("x0"), F.col("x1")) & (F.col("a_y0") < F.col("y0") - 2)
    gaps = like.select("t_id", *PAGE, "x0", "x1", "y0").join(dealt(above), PAGE).groupBy("t_id").agg(F.max(F.when(near, F.col("a_y0"))).alias("a_y0"))
    small = (F.col("body_size") > 0) & (F.col("size") <= F.col("body_size") * 0.95)
    apart = F.col("a_y0").isNull() | (F.col("y0") - F.col("a_y0") >= C.GAP_PT)
    wide = F.col("right") - F.col("left")
    indented = (wide > 0) & ((F.col("x0") - F.col("left")) >= wide * 0.15)
    return like.join(dealt(gaps), "t_id", "left").where(small | apart | indented).drop("a_y0")


def region_edge(captions: DataFrame, lines: DataFrame, above: bool) -> DataFrame:
    """How far a region reaches from its caption: walking away over lines that overlap the caption, to the last line that is
    no prose before the third prose line in a row or the height's limit; of lines of one height the first comes first.
    captions: t_id, page, x0, x1, y0, y1, height, lo, hi, left, right. Gives t_id and edge."""
    # A target stands on one page, so all windows keep the dealing by page that the join needs: no pair is dealt anew.
    one = [*PAGE, "t_id"]
    l = _told(lines, "line_no", "size", "x0", "x1", "y0", "y1")
    c = captions.select("t_id", *PAGE, F.col("x0").alias("c_x0"), F.col("x1").alias("c_x1"), F.col("y0").alias("c_y0"), F.col("y1").alias("c_y1"), "height", "lo", "hi", "left", "right")
    y0, top, bottom = F.col("y0"), F.col("c_y0"), F.col("c_y1")
    reach = overlaps(F.col("x0"), F.col("x1"), F.col("c_x0"), F.col("c_x1"))
    if above:
        near = (y0 < top - 2) & (y0 >= F.greatest(top - F.col("height") * C.MAX_HEIGHT_RATIO, F.lit(0.0)))
        order, value, start = [y0.desc(), F.col("line_no").asc()], y0 - 2, top
    else:
        near = (y0 > bottom + 1) & (y0 <= F.least(bottom + F.col("height") * C.MAX_BELOW_RATIO, F.col("height")))
        order, value, start = [y0.asc(), F.col("line_no").asc()], F.coalesce("y1", y0 + 8), bottom
    walk = Window.partitionBy(*one).orderBy(*order)
    rows = c.join(dealt(l), PAGE).where(reach & near).withColumn("prose", is_prose(F.col("lo"), F.col("hi"), F.col("right") - F.col("left")).cast("int"))
    rows = rows.withColumn("n", F.row_number().over(walk)).withColumn("run", F.sum("prose").over(walk.rowsBetween(1 - C.PROSE_RUN, 0)))
    stop = F.min(F.when(F.col("run") == C.PROSE_RUN, F.col("n"))).over(Window.partitionBy(*one))
    rows = rows.withColumn("stop", stop).where((F.col("prose") == 0) & (F.col("stop").isNull() | (F.col("n") < F.col("stop"))))
    last = rows.groupBy(*one).agg(F.max_by(value, "n").alias("far"))
    return c.join(dealt(last), one, "left").select("t_id", F.coalesce("far", start).alias("edge"))


def ink_box(captions: DataFrame, graphics: DataFrame) -> DataFrame:
    """The box of all graphics of the page that share heights with a region (t_id, page, y0, y1, width, height); too large
    and degenerate ones do not count. No row without any."""
    g = graphics.select(*PAGE, *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    area = (F.col("g_x1") - F.col("g_x0")) * (F.col("g_y1") - F.col("g_y0"))
    fine = (F.col("g_x1") > F.col("g_x0")) & (F.col("g_y1") > F.col("g_y0")) & (area <= F.col("width") * F.col("height") * C.MAX_GRAPHIC_RATIO)
    meets = (F.col("g_y1") > F.col("y0")) & (F.col("g_y0") < F.col("y1"))
    return captions.select("t_id", *PAGE, "y0", "y1", "width", "height").join(dealt(g), PAGE).where(fine & meets).groupBy("t_id").agg(
        F.min("g_x0").alias("x0"), F.min("g_y0").alias("y0"), F.max("g_x1").alias("x1"), F.max("g_y1").alias("y1")
    )


def label_growth(seeds: DataFrame, lines: DataFrame) -> DataFrame:
    """The span of each seed (t_id, page, box, lo, hi) grown by the lines between its top and bottom that are no prose, as
    long as one is within 40 points: the island of merged intervals that holds the seed. No row where no such line is."""
    one = [*PAGE, "t_id"]  # a seed stands on one page, by which lines and seeds are dealt
    s = seeds.select("t_id", *PAGE, "x0", "x1", F.lit(True).alias("seed"))
    box = seeds.select("t_id", *PAGE, *[F.col(c).alias(f"r_{c}") for c in ("x0", "x1", "y0", "y1")], "lo", "hi")
    l = box.join(dealt(_told(lines, "x0", "x1", "y0", "size")), PAGE)
    l = l.where(F.col("y0").between(F.col("r_y0"), F.col("r_y1")) & ~is_prose(F.col("lo"), F.col("hi"), F.col("r_x1") - F.col("r_x0")))
    order = Window.partitionBy(*one).orderBy("x0", "x1", F.col("seed").desc())
    rows = s.unionByName(l.select("t_id", *PAGE, "x0", "x1", F.lit(False).alias("seed")))
    rows = rows.withColumn("reach", F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rows", F.count("*").over(Window.partitionBy(*one)))
    rows = rows.withColumn("island", F.sum(F.coalesce((F.col("x0") - F.col("reach") > C.GROW_GAP).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.where(F.col("rows") > 1).groupBy(*one, "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.bool_or("seed").alias("seed"))
    return islands.where("seed").select("t_id", "x0", "x1")


def expanded(regions: DataFrame, ink: DataFrame, spans: DataFrame, lines: DataFrame) -> DataFrame:
    """regions (t_id, page, box, width, height, lo, hi) joined with their ink and label spans, inside the page; as before
    where that would swallow a further prose line."""
    i = ink.select("t_id", *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")])
    s = spans.select("t_id", F.col("x0").alias("s_x0"), F.col("x1").alias("s_x1"))
    r = regions.join(dealt(i), "t_id", "left").join(dealt(s), "t_id", "left")
    r = (
        r.withColumn("n_x0", F.greatest(F.lit(0.0), F.least("x0", F.col("i_x0") - C.FIG_PAD, F.col("s_x0") - C.FIG_PAD)))
        .withColumn("n_x1", F.least("width", F.greatest("x1", F.col("i_x1") + C.FIG_PAD, F.col("s_x1") + C.FIG_PAD)))
        .withColumn("n_y0", F.greatest(F.lit(0.0), F.least("y0", F.col("i_y0") - 2)))
        .withColumn("n_y1", F.least("height", F.greatest("y1", F.col("i_y1") + 2)))
    )
    l = _told(lines, F.col("x0").alias("l_x0"), F.col("x1").alias("l_x1"), F.col("y0").alias("l_y0"), "size")
    middle = (F.col("l_x0") + F.col("l_x1")) / 2
    within = lambda p: middle.between(F.col(f"{p}x0"), F.col(f"{p}x1")) & F.col("l_y0").between(F.col(f"{p}y0"), F.col(f"{p}y1"))
    prose = is_prose(F.col("lo"), F.col("hi"), F.col("x1") - F.col("x0"), F.col("l_x0"), F.col("l_x1"))
    swallowed = r.join(dealt(l), PAGE).where(within("n_") & ~within("") & prose).select("t_id").distinct().withColumn("bad", F.lit(True))
    out = r.join(dealt(swallowed), "t_id", "left")
    return out.select(*[c for c in regions.columns if c not in ("x0", "y0", "x1", "y1")], *[F.when(F.col("bad"), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


def is_display_equation(column_width: Column) -> Column:
    return (F.col("math") >= C.MATH_MIN) & (column_width > 0) & ((F.col("x1") - F.col("x0")) < column_width * C.EQ_WIDTH_MAX)


def is_substantial(c: Column) -> Column:
    solid = F.length(F.regexp_replace(c, rf"(?U)[{C.SPACE}]", ""))
    return (solid >= C.EQ_MIN_CHARS) & (c.rlike(C.EQUATION_OP) | c.rlike(C.EQUATION_NUMBER))


def equation_regions(lines: DataFrame) -> DataFrame:
    """Groups of lines (doc_id, pno, line_no, box, text) that are display equations and no gap above 6 points or 1.6 heights
    apart, if there is enough to them: page, island, padded box, y (the top without padding) and text. Columns are not told
    apart."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "line_no")
    gap = F.col("y0") - F.lag("y1").over(order)
    limit = F.greatest(F.lit(6.0), (F.lag("y1").over(order) - F.lag("y0").over(order)) * 1.6)
    rows = lines.withColumn("new", F.coalesce((gap > limit).cast("int"), F.lit(0)))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*PAGE, "island").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sort_array(F.collect_list(F.struct("y0", "line_no", "text"))).alias("l")
    )
    text = F.array_join(F.transform("l", lambda x: x["text"]), " ")
    return found.withColumn("text", text).where(is_substantial(F.col("text"))).select(
        *PAGE, "island", (F.col("x0") - C.FIG_PAD).alias("x0"), (F.col("y") - C.PAD).alias("y0"), (F.col("x1") + C.FIG_PAD).alias("x1"), (F.col("y1") + C.PAD).alias("y1"), "y", "text"
    )


def math_dominant(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Tables (t_id, page, box) that are equations: half their characters or more are mathematical, and there is enough."""
    l = lines.select(*PAGE, "line_no", "text", "math", F.col("x0").alias("l_x0"), F.col("x1").alias("l_x1"), F.col("y0").alias("l_y0"))
    middle = (F.col("l_x0") + F.col("l_x1")) / 2
    rows = tables.join(dealt(l), PAGE).where(middle.between(F.col("x0"), F.col("x1")) & F.col("l_y0").between(F.col("y0"), F.col("y1")))
    found = rows.groupBy("t_id").agg(
        F.sum(F.length("text") * F.coalesce("math", F.lit(0.0))).alias("m"), F.sum(F.length("text")).alias("n"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l")
    )
    text = F.array_join(F.transform("l", lambda x: x["text"]), " ")
    return found.where((F.col("n") > 0) & (F.col("m") / F.col("n") >= C.EQ_DOMINANT) & is_substantial(text)).select("t_id")


def anchor_above(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """The text of the nearest line above each target (t_id, page, y0, left, right) in its column; empty without any. The
    first of equal ones counts."""
    # A sweep down each column: its lines by their ends and the targets by their tops in one order, the last line above
    # counts. A page has few columns, so a line is in few sweeps, whatever the number of targets.
    column = [*PAGE, "left", "right"]
    middle = (F.col("x0") + F.col("x1")) / 2
    l = lines.join(dealt(targets.select(*column).distinct()), PAGE).where(middle.between(F.col("left") - 2, F.col("right") + 2))
    l = l.select(*column, F.col("y1").alias("at"), F.lit(False).alias("target"), (-F.col("line_no")).cast("long").alias("tie"), F.struct("text").alias("line"), F.lit(None).cast(targets.schema["t_id"].dataType).alias("t_id"))
    t = targets.select(*column, (F.col("y0") + 1).alias("at"), F.lit(True).alias("target"), F.lit(None).cast("long").alias("tie"), F.lit(None).cast("struct<text:string>").alias("line"), "t_id")
    sweep = Window.partitionBy(*column).orderBy("at", "target", "tie").rowsBetween(Window.unboundedPreceding, 0)
    found = l.unionByName(t).withColumn("above", F.last("line", ignorenulls=True).over(sweep)).where("target")
    return found.select("t_id", F.coalesce("above.text", F.lit("")).alias("anchor"))


def caption_regions(captions: DataFrame, lines: DataFrame) -> DataFrame:
    """The region of each caption (t_id, page, x0..y1, text, width, height, lo, hi, left, right): tables are looked for below
    it first, figures above; the first side that gives 40 points counts. Captions without any have none."""
    up = region_edge(captions, lines, True).withColumnRenamed("edge", "top")
    down = region_edge(captions, lines, False).withColumnRenamed("edge", "bottom")
    r = captions.join(dealt(up), "t_id").join(dealt(down), "t_id")
    above = F.when(F.col("y0") - F.col("top") >= C.MIN_HEIGHT, F.struct(F.col("top").alias("y0"), (F.col("y0") - 2).alias("y1")))
    below = F.when(F.col("bottom") - F.col("y1") >= C.MIN_HEIGHT, F.struct((F.col("y1") + 1).alias("y0"), (F.col("bottom") + 2).alias("y1")))
    table = T.strip(F.col("text")).rlike(C.TABLE_CAPTION)
    r = r.withColumn("box", F.when(table, F.coalesce(below, above)).otherwise(F.coalesce(above, below))).where(F.col("box").isNotNull())
    return r.select(
        "t_id", *PAGE, (F.col("left") - C.FIG_PAD).alias("x0"), F.col("box.y0").alias("y0"), (F.col("right") + C.FIG_PAD).alias("x1"), F.col("box.y1").alias("y1"), F.col("text").alias("cap_text"), "width", "height", "lo", "hi",
    )


BOX = ("x0", "y0", "x1", "y1")


def plan(lines: DataFrame, pages: DataFrame, tables: DataFrame | None = None, graphics: DataFrame | None = None) -> DataFrame:
    """The regions of all pages, in the order in which they depend on each other: doc_id, pno, box, y, kind (table, figure,
    equation), cap_text, anchor, n (on the page, from 1), name and link.

    lines: layout's, of all pages; tables (doc_id, pno, box): found tables, or none; graphics (doc_id, pno, box): drawings
    and images, or none. Tables are padded, and are equations where mathematics has most of them. Captions get what lies
    above or below them, grown to ink and labels. Display equations are lines outside all these. Equations know the text
    above them. Regions are numbered by height; at one height tables come first, then captions, then equations. What
    several steps read is written once (foliant.shared); without that the plan would hold each step many times over.
    """
    spark, columns = lines.sparkSession, [*PAGE, *BOX, "y", "kind", "cap_text", "anchor", "rank", "at"]
    none = spark.createDataFrame([], lines.select(*PAGE, *BOX).schema)
    text = lambda c: F.lit(c).cast("string")
    band = layout.body_measures(lines)
    placed = lines.join(dealt(pages), PAGE).withColumn("t_id", F.struct(*PAGE, "line_no"))
    placed = cut(column_bounds(placed, lines).join(dealt(band), "doc_id", "left").na.fill({"body_size": 0.0, "lo": 0.0, "hi": 0.0}).withColumn("tabular", T.is_table_row(F.col("text"))), "placed-lines")
    lines = placed.select(*lines.columns, "tabular")

    pad = (none if tables is None else tables).select(*PAGE, *BOX)
    rect = pad.select(*PAGE, (F.col("x0") - C.PAD).alias("x0"), (F.col("y0") - C.PAD).alias("y0"), (F.col("x1") + C.PAD).alias("x1"), (F.col("y1") + 1).alias("y1"), F.col("y0").alias("y"))
    rect = rect.distinct().withColumn("t_id", F.struct(*PAGE, *BOX))
    as_math = math_dominant(rect, lines).withColumn("is_math", F.lit(True))
    with_width = lambda r: column_bounds(r.join(dealt(pages.select(*PAGE, "width")), PAGE), lines)
    found = rect.join(dealt(as_math), "t_id", "left").join(dealt(anchor_above(with_width(rect), lines)), "t_id", "left")
    is_math = F.coalesce("is_math", F.lit(False))
    made = found.select(*PAGE, *BOX, "y", F.when(is_math, "equation").otherwise("table").alias("kind"), text(None).alias("cap_text"), F.when(is_math, F.col("anchor")).alias("anchor"), F.lit(0).alias("rank"), F.col("x0").alias("at"))
    made = cut(made, "table-regions")

    regions = cut(caption_regions(cut(captions(placed), "captions"), lines), "caption-regions")
    regions = expanded(regions, ink_box(regions, none if graphics is None else graphics), label_growth(regions, lines), lines)
    figures = regions.select(*PAGE, *BOX, F.col("y0").alias("y"), text("figure").alias("kind"), "cap_text", text(None).alias("anchor"), F.lit(1).alias("rank"), F.col("t_id.line_no").cast("double").alias("at"))
    figures = cut(figures, "figure-regions")

    left = cut(outside(placed, made.unionByName(figures)).where(is_display_equation(F.col("right") - F.col("left"))), "equation-lines")
    groups = cut(equation_regions(left), "equation-regions").withColumn("t_id", F.struct(*PAGE, "island"))
    others = lines.join(dealt(left.select(*PAGE, "line_no")), [*PAGE, "line_no"], "left_anti")
    # The column of an equation is that of all lines of its page; its own lines are no anchors.
    anchors = anchor_above(with_width(groups), others)
    equations = groups.join(dealt(anchors), "t_id").select(*PAGE, *BOX, "y", text("equation").alias("kind"), text(None).alias("cap_text"), "anchor", F.lit(2).alias("rank"), F.col("island").cast("double").alias("at"))

    every = made.select(*columns).unionByName(figures.select(*columns)).unionByName(equations.select(*columns))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "rank", "at")).alias("n")
    kind = F.when(F.col("kind") == "equation", F.lit("eq")).otherwise(F.lit("fig"))
    name = F.concat(kind, F.format_string("-p%03d-%02d.png", F.col("pno") + 1, F.col("n")))
    return every.select(*PAGE, *BOX, "y", "kind", "cap_text", "anchor", n).withColumn("name", name).withColumn("link", F.concat(F.lit("![](images/"), F.col("name"), F.lit(")")))


def crop(regions: DataFrame) -> DataFrame:
    """The part of each region on its page, and whether it is worth an image."""
    clipped = regions.withColumns({"x0": F.greatest("x0", F.lit(0.0)), "y0": F.greatest("y0", F.lit(0.0)), "x1": F.least("x1", "width"), "y1": F.least("y1", "height")})
    least = F.when(F.col("kind") == "equation", F.lit(C.EQ_MIN_HEIGHT)).otherwise(F.lit(C.MIN_HEIGHT))
    return clipped.withColumn("rendered", (F.col("x1") > F.col("x0")) & (F.col("y1") - F.col("y0") >= least))


def pick_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Placed images (doc_id, pno, xref, box) that stand on one page only and have 3 to 60 % of it."""
    once = images.groupBy("doc_id", "xref").agg(F.count_distinct("pno").alias("pages")).where(F.col("pages") == 1).drop("pages")
    ratio = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))
    return images.join(dealt(once), ["doc_id", "xref"]).join(dealt(pages), PAGE).withColumn("ratio", ratio).where(F.col("ratio").between(C.MIN_IMG_RATIO, C.MAX_IMG_RATIO)).drop("width", "height")
