import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T


def values(spark, of, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", of(F.col("t")).alias("v")).orderBy("i").collect()]


def test_looks_like_text(spark):
    yes = ["ENTERPRISE PERFORMANCE", "DAVID J. TEECE*", "3. METHODS", "Nature", "그림 개요", "표 1 요약"]
    no = ["il", "* lnf?rSc??Tic??", "?S.SZ o .2", "Isl11?", "C0 g", "MA.", "1350", ""]
    assert values(spark, T.looks_like_text, yes + no) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    ("before", "part", "out"), [("ends with communi-", "cation", "ends with communication"), ("ends with word", "next", "ends with word next"), ("", "first", "first"), ("dash -", "x", "dash - x")]
)
def test_join_unit(spark, before, part, out):
    assert spark.range(1).select(T.join_unit(F.lit(before), F.lit(part)).alias("v")).first()["v"] == out


def test_names_and_sizes(spark):
    assert values(spark, T.sanitize, ["Peteraf - 2026 - The Cornerstones"]) == ["Peteraf_-_2026_-_The_Cornerstones"]
    assert values(spark, T.norm_len, ["가 나\n다-", "a­b c"]) == [3, 3]
    assert values(spark, T.key, ["가나 a_b, é! X"]) == ["가나a_béx"]
    assert values(spark, T.work_stem, ["_가나 (1)! x.pdf_"]) == ["가나_1_x.pdf"]
    assert values(spark, T.safe_stem, ["a b", "a/b", "..", "a:b"]) == [True, False, False, False]
    assert values(spark, T.repeat_norm, ["180 A. Author", "1342 D. J.  Teece 7", "1342"]) == ["a. author", "d. j. teece", "#"]


def test_page_numbers_and_references(spark):
    rows = spark.createDataFrame([("1342", 40.0), ("1342", 780.0), ("1342", 400.0), ("1342 D. J. Teece", 40.0)], "t string, y double")
    assert [r[0] for r in rows.select(T.is_page_number(F.col("t"), F.col("y"), F.lit(800.0))).collect()] == [True, True, False, False]
    two = spark.createDataFrame([("Figure 4). Furthermore", "it can earn (see"), ("Figure 4. The axis", "Diversification")], "t string, p string")
    assert [r[0] for r in two.select(T.is_figure_xref(F.col("t"), F.col("p"))).collect()] == [True, False]


def test_continuations(spark):
    texts = ["−→ coherent wave", "“emergence score” by", "“Emergence score", "then it goes", "Then", "→ x", ""]
    assert values(spark, T.is_continuation, texts) == [True, True, False, True, False, True, False]


def test_ends_properly(spark):
    texts = ["ends.", "so (Rumelt, 1987). 13", "needs.16", "as he said:", "cut in the mid", "bold.**", "", "끝」"]
    assert values(spark, T.ends_properly, texts) == [True, True, True, True, False, True, False, True]


def test_math(spark):
    assert values(spark, T.is_math_block, ["A = θ S (6)", "# ∑ x", "> a = b", "The long sentence holds that here a = b", ""]) == [True, True, False, False, False]
    spans = F.array(F.struct(F.lit("abcd").alias("text"), F.lit("NimbusRomNo9L-Regu").alias("font")), F.struct(F.lit("xy").alias("text"), F.lit("CMMI10").alias("font")))
    assert spark.range(1).select(T.math_ratio(spans)).first()[0] == pytest.approx(2 / 6)


def test_clean(spark):
    dirty = "a  \n\n\n\nb\n------\n## **Title** \nx<!-- Start of picture text -->\nq\n<!-- End of picture text -->\ny­\n"
    assert values(spark, T.clean, [dirty]) == ["a\n\nb\n## Title\nxy\n"]


def test_leading_words(spark):
    found = spark.range(1).select(T.leading_repeat_words(F.lit("12 Preprint not peer reviewed The text"), F.array(F.lit("preprint not peer reviewed")))).first()[0]
    assert found == 5


def test_numbers_and_citations(spark):
    rows = spark.createDataFrame([("In 1993. and 1994, 3.14 or 12 (Berryman, 1983)", "1994 (Cannady et al., 2014)")], "a string, b string")
    from foliant.operators import checks

    got = rows.select(checks.missing_numbers(F.col("a"), F.col("b")), checks.missing_integers(F.col("a"), F.col("b")), checks.missing_citations(F.col("a"), F.col("b"))).first()
    assert got[0] == ["1983", "3.14"] and got[1] == ["12"] and [tuple(c) for c in got[2]] == [("Berryman", "1983")]


def test_trimming_takes_what_the_class_takes(spark):
    from foliant import config as C

    every = "".join(chr(c) for c in [*range(0x3100), 0xFEFF] if not 0xD800 <= c < 0xE000)
    rows = spark.createDataFrame([(c,) for c in every], "c string")
    spaces = rows.where(F.col("c").rlike(rf"(?U)^[{C.SPACE}]\z"))
    assert sorted(r["c"] for r in spaces.collect()) == sorted(C.SPACES)
    both = F.concat(F.lit(C.SPACES), F.lit("a b"), F.lit(C.SPACES))
    assert spark.range(1).select(T.strip(both), T.rstrip(both), T.lstrip(both)).first()[:] == ("a b", C.SPACES + "a b", "a b" + C.SPACES)


def test_rows_of_numbers(spark):
    made = ["1 2 3", " 1\t2\u00a0 3.5\n", "1 2", "a 1,2 b 3% c (4)", "1 2x 3", "a * b", "a * b * c", "**", "*", "a | b", "\u0661 \u0662 \u0663", ""]
    df = spark.createDataFrame([(t,) for t in made], "t string")
    got = [tuple(r) for r in df.select(T.number_tokens(F.col("t")), T.is_table_row(F.col("t"))).collect()]
    token = re.compile(r"[0-9.,%$/\[\]()·~-]+")
    want = [sum(bool(token.fullmatch(w)) for w in t.split()) for t in made]
    assert got == [(n, t.count("*") >= 2 or "|" in t or n >= 3) for n, t in zip(want, made, strict=True)]
    # One pass over a text, and none that makes another text of it.
    assert "regexp_replace" not in str(T.is_table_row(F.col("t")))


def test_running_heads_against_a_loop(spark):
    rng = random.Random(5)
    words = ["12", "the", "Model", "7", "a3"]
    norm = lambda t: re.sub(r"\d+", "#", re.sub(r"^\d+\s+|\s+\d+$", "", t.lower())).strip()
    rows = []
    for _ in range(150):
        heads = [norm(" ".join(rng.choices(words, k=rng.randint(1, 3)))) for _ in range(rng.randint(0, 4))]
        rows += [(heads, " ".join(rng.choices(words, k=rng.randint(1, 5))))]
    df = spark.createDataFrame(rows, "heads array<string>, t string")
    n = [T.leading_repeat_words(F.col("t"), F.col("heads"), firsts=f) for f in (T.first_words(F.col("heads")), None)]
    got = [tuple(r) for r in df.select(*n).collect()]
    for (heads, t), (with_firsts, without) in zip(rows, got, strict=True):
        w = t.split()
        want = max((k for k in range(1, len(w) + 1) if norm(" ".join(w[:k])) in heads), default=0)
        assert with_firsts == without == want, (heads, t)
