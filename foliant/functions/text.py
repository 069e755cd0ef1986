"""Column functions on text: normal forms, tests of lines and paragraphs, and counts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import config as C


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(C.SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(C.SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(C.SPACES))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"(?U)[{C.SPACE}]+", " "))


def ends_with_any(c: Column, marks: str) -> Column:
    return F.length(c).__gt__(0) & (F.instr(F.lit(marks), F.right(c, F.lit(1))) > 0)


def starts_with_any(c: Column, marks: str) -> Column:
    first = F.substring(lstrip(c), 1, 1)
    return F.length(first).__gt__(0) & (F.instr(F.lit(marks), first) > 0)


def key(c: Column) -> Column:
    return F.substring(norm_flat(c), 1, 40)


def norm_flat(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\W+", ""))


def norm_len(c: Column) -> Column:
    """Characters that count for coverage: no white space, soft hyphens or hyphens."""
    return F.length(F.regexp_replace(c, rf"(?U)[{C.SPACE}\u00AD\-]+", "")).cast("long")


def repeat_norm(c: Column) -> Column:
    """What two running heads have in common: case, spaces and numbers aside."""
    bare = F.regexp_replace(F.lower(collapse(c)), r"(?U)^\d+\s+|\s+\d+$", "")
    return strip(F.regexp_replace(bare, r"(?U)\d+", "#"))


def letter_share(c: Column) -> Column:
    solid = F.length(F.regexp_replace(c, rf"(?U)[{C.SPACE}]+", ""))
    return F.when(solid > 0, F.length(F.regexp_replace(c, r"\P{L}+", "")) / solid).otherwise(F.lit(0.0))


def looks_like_text(c: Column) -> Column:
    return (letter_share(c) >= C.LETTER_RATIO) & c.rlike(C.WORDISH)


def is_scan_debris(text: Column, size: Column, body: Column) -> Column:
    return (body > 0) & (size > 0) & (size >= body * C.HEADING_MIN) & (F.length(strip(text)) < 80) & ~looks_like_text(strip(text))


def is_page_number(text: Column, y0: Column, height: Column) -> Column:
    return ~((y0 > height * C.MARGIN) & (y0 < height * (1 - C.MARGIN))) & strip(text).rlike(C.NUMBER_ONLY)


def is_figure_xref(text: Column, previous: Column) -> Column:
    """A reference that closes the bracket of the line before, not a caption."""
    p = F.coalesce(previous, F.lit(""))
    return strip(text).rlike(C.XREF_CLOSE) & (F.regexp_count(p, F.lit(r"\(")) > F.regexp_count(p, F.lit(r"\)")))


def is_caption_text(c: Column) -> Column:
    return strip(c).rlike(C.CAPTION)


def is_body(c: Column) -> Column:
    return ~starts_with_any(c, "#>!|")


def is_continuation(c: Column) -> Column:
    return lstrip(c).rlike(C.CONTINUATION)


def without_head(c: Column) -> Column:
    return F.regexp_replace(strip(c), C.MD_HEAD, "")


def is_math_block(c: Column) -> Column:
    t = without_head(c)
    return F.length(t).between(1, C.MATH_UNIT_MAX) & ~F.substring(t, 1, 1).isin(">", "!", "|") & t.rlike(C.MATH_OP) & (F.regexp_count(t, F.lit(C.PROSE_WORD)) <= 3)


def first_words(norms: Column) -> Column:
    """The distinct first words of an array of normal forms."""
    return F.array_distinct(F.transform(norms, lambda n: F.substring_index(n, " ", 1)))


def leading_repeat_words(c: Column, repeated: Column, most: int = 20, firsts: Column | None = None) -> Column:
    """How many words at the start are a running head of repeated (an array of normal forms); 0: none. firsts: their first
    words (first_words), if known, by which most texts are found to begin with none.

    The normal form of some first words is put together from words that are normal themselves; a number at either end,
    beside other words, does not count.
    """
    firsts = first_words(repeated) if firsts is None else firsts
    head = F.regexp_extract(strip(c), rf"(?U)^(?:[^{C.SPACE}]+[{C.SPACE}]*){{1,{most}}}", 0)  # so that long texts cost no more than short ones
    number = lambda w: w.rlike(r"(?U)^\d+$")
    normal = lambda w: F.regexp_replace(F.lower(w), r"(?U)\d+", "#")

    def longest(x: Column) -> Column:
        plain, numbers = x["plain"], x["numbers"]
        skip = F.when(F.get(numbers, F.lit(0)), 1).otherwise(0)

        def hit(n: Column) -> Column:
            first = F.when(n > 1, skip).otherwise(0)
            last = F.when(F.get(numbers, n - 1) & (n - first > 1), n - 1).otherwise(n)
            return F.array_contains(repeated, F.array_join(F.slice(plain, first + 1, last - first), " "))

        return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.size(plain)), hit)), F.lit(0))

    # Bound once: an expression inside a lambda runs anew for each element.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def begun(words: Column) -> Column:
        one, two = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        may = F.array_contains(firsts, normal(one)) | (number(one) & F.array_contains(firsts, F.coalesce(normal(two), F.lit(""))))
        made = F.struct(F.transform(words, normal).alias("plain"), F.transform(words, number).alias("numbers"))
        return F.when(may, bound(made, longest)).otherwise(F.lit(0))

    return F.when(F.size(repeated) > 0, bound(F.split(collapse(head), " "), begun)).otherwise(F.lit(0))


def join_unit(before: Column, part: Column) -> Column:
    """A line after another: a hyphen after a letter goes, else a space stands between. Only the end of before is looked at,
    which may be all lines so far."""
    return (
        F.when(before == "", part)
        .when(F.right(before, F.lit(3)).rlike(r"(?Ud)\w-$"), F.concat(F.left(before, F.length(before) - 1), part))
        .otherwise(F.concat(before, F.lit(" "), part))
    )


def joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(""), lambda a, p: join_unit(a, p))


def ends_properly(c: Column) -> Column:
    bare = F.regexp_replace(rstrip(c), r"(?Ud)(?<=[.!?])\s?\d{1,3}$", "")
    return ends_with_any(F.regexp_replace(bare, r"[_*^~`]+$", ""), C.SCORE_END)


def clean(c: Column) -> Column:
    """The order of the steps is part of the rule."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"-----+\n", "")
    c = F.regexp_replace(c, r"(?s)<!-- Start of picture text -->.*?<!-- End of picture text -->\n?", "")
    c = F.regexp_replace(c, r"(?Udm)^(#{1,6})\s+\*\*(.+?)\*\*\s*$", "$1 $2")
    c = F.regexp_replace(c, r"(?dm)[ \t]+$", "")
    return F.concat(strip(F.regexp_replace(c, "\u00ad", "")), F.lit("\n"))


def hangul_ratio(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit("[A-Za-z가-힣]"))
    return F.when(letters > 0, F.regexp_count(c, F.lit("[가-힣]")) / letters).otherwise(F.lit(1.0))


def has_hangul(c: Column) -> Column:
    return c.rlike("[가-힣]")


def work_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w,.-]+", "_"), "^_+|_+$", "")


def sanitize(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"(?U)[{C.SPACE}]+", "_")


def safe_stem(c: Column) -> Column:
    """Whether a name may be used as a folder of its own."""
    return c.rlike(C.STEM) & ~c.isin(".", "..")


def number_tokens(c: Column) -> Column:
    """Words of digits and their marks, between spaces of any kind."""
    space = rf"(?U:[{C.SPACE}])"
    return F.regexp_count(c, F.lit(rf"(?:^|{space}){C.NUMBER_TOKEN}(?={space}|\z)"))


def is_table_row(c: Column) -> Column:
    return F.contains(c, F.lit("|")) | (F.length(c) - F.length(F.replace(c, F.lit("*"), F.lit(""))) >= 2) | (number_tokens(c) >= 3)


def math_ratio(spans: Column) -> Column:
    """Share of characters in mathematical fonts, of an array of (text, font); 0 without characters."""
    total = F.aggregate(spans, F.lit(0), lambda a, s: a + F.length(s["text"]))
    part = F.aggregate(F.filter(spans, lambda s: s["font"].rlike(C.MATH_FONT)), F.lit(0), lambda a, s: a + F.length(s["text"]))
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def stitch_norm(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"(?U)\d+", ""))


def is_bare_number(c: Column) -> Column:
    return c.rlike(r"(?Ud)^_?\d{1,4}_?$")


def body_before_references(c: Column) -> Column:
    at = F.regexp_instr(c, F.lit(C.REFERENCES))
    return F.when(at > 0, F.left(c, at - 1)).otherwise(c)


def image_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(C.IMAGE_LINK), F.lit(1))


def first_heading(c: Column) -> Column:
    found = F.filter(F.split(c, r"\R"), lambda line: line.rlike(C.SECTION_LINE))
    return F.coalesce(strip(F.get(found, F.lit(0))), F.lit(""))


def log_tail(c: Column, n: int = 8000) -> Column:
    return F.right(c, F.lit(n))


def missing(source: Column, other: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches in source that other lacks, in order."""
    return F.array_sort(F.array_except(F.regexp_extract_all(source, F.lit(pattern), F.lit(group)), F.regexp_extract_all(other, F.lit(pattern), F.lit(group))))


def citations(c: Column) -> Column:
    whole = F.regexp_extract_all(c, F.lit(C.CITATION), F.lit(0))
    return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, C.CITATION, 1).alias("author"), F.regexp_extract(m, C.CITATION, 2).alias("year")))


def units(c: Column) -> Column:
    """Blocks between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda u: u != "")
