"""Checks of a translation against its source, and the final table of checks. pairs: doc_id, id, source, translation (null: there is none)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import text as T



def _s(c: Column | None) -> Column:
    return F.col("source") if c is None else c


def _r(c: Column | None) -> Column:
    return F.col("translation") if c is None else c


def count_blocks(c: Column) -> Column:
    return F.size(T.units(c))


def count_headings(c: Column) -> Column:
    return F.regexp_count(c, F.lit(C.HEADING_LINE))


def count_table_rows(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\R"), lambda line: F.startswith(line, F.lit("|"))))


def missing_numbers(source: Column | None = None, other: Column | None = None) -> Column:
    return T.missing(_s(source), _r(other), C.YEAR_OR_DECIMAL)


def missing_integers(source: Column | None = None, other: Column | None = None) -> Column:
    """Only a warning: small numbers often become words."""
    source, other = _s(source), _r(other)
    every = F.array_except(F.regexp_extract_all(source, F.lit(C.INTEGER), F.lit(0)), F.regexp_extract_all(source, F.lit(C.YEAR_OR_DECIMAL), F.lit(0)))
    return F.array_sort(F.array_except(every, F.regexp_extract_all(other, F.lit(C.INTEGER), F.lit(0))))


def missing_citations(source: Column | None = None, other: Column | None = None) -> Column:
    return F.array_sort(F.array_except(T.citations(_s(source)), T.citations(_r(other))))


def missing_image_links(source: Column | None = None, other: Column | None = None) -> Column:
    other = _r(other)
    return F.filter(T.image_links(_s(source)), lambda link: ~F.contains(other, link))


def untranslated_footnotes(c: Column | None = None) -> Column:
    notes = F.filter(T.units(_r(c)), lambda p: F.startswith(p, F.lit(">")) & ~p.rlike(C.AFFILIATION))
    bodies = F.transform(notes, lambda p: F.regexp_replace(p, C.FOOTNOTE_LABEL, ""))
    return F.filter(bodies, lambda b: (F.length(b) > 40) & ~T.has_hangul(b))


def english_left(c: Column | None = None) -> Column:
    plain = lambda p: ~F.substring(p, 1, 1).isin("|", "!", "$") & ~F.startswith(p, F.lit("```"))
    return F.filter(F.split(_r(c), "\n\n"), lambda p: (F.length(p) > 200) & ~T.has_hangul(p) & plain(p))


def untranslated_body(c: Column) -> Column:
    return F.filter(F.split(T.body_before_references(c), "\n\n"), lambda p: (F.length(T.strip(p)) > 80) & T.is_body(p) & ~T.has_hangul(p))


def is_references(c: Column | None = None) -> Column:
    """Chunks of references: by heading, or by more than half of their lines."""
    c = _s(c)
    lines = F.split(c, r"\R")
    entries = F.size(F.filter(lines, lambda x: x.rlike(r"^-\s*\[")))
    solid = F.size(F.filter(lines, lambda x: T.strip(x) != ""))
    return c.rlike(r"(?im)^#+\s*(References|참고문헌)") | F.coalesce((solid > 0) & (entries / solid > 0.5), F.lit(False))


def problems(files: Column | None = None) -> list[Column]:
    """One array of texts for each rule; empty where it holds. files: array of the paths that exist."""
    refs, S, R = is_references(), _s(None), _r(None)  # noqa: N806
    say = lambda text, items: F.transform(items, lambda x: F.concat(F.lit(text), x))

    def unequal(name: str, count) -> Column:
        a, b = count(S), count(R)
        return F.when(a != b, F.array(F.concat(F.lit(f"{name} "), a.cast("string"), F.lit("→"), b.cast("string")))).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    gone = F.filter(T.image_links(S), lambda x: F.contains(R, x) & ~F.array_contains(files, x)) if files is not None else none
    ratio = T.hangul_ratio(R)
    return [
        say("missing image link ", missing_image_links()),
        say("image file not found: ", gone),
        say("missing number ", missing_numbers()),
        F.transform(missing_citations(), lambda c: F.concat(F.lit("missing citation ("), c["author"], F.lit(", "), c["year"], F.lit(")"))),
        unequal("paragraph count", count_blocks),
        F.transform(untranslated_footnotes(), lambda b: F.concat(F.lit("untranslated footnote: "), F.left(b, F.lit(50)))),
        unequal("heading count", count_headings),
        unequal("table rows", count_table_rows),
        F.when(~refs & (ratio < 0.5), F.array(F.format_string("hangul ratio %.2f (untranslated?)", ratio))).otherwise(none),
        F.when(~refs, F.transform(english_left(), lambda p: F.concat(F.lit("english paragraph left: "), F.left(p, F.lit(60))))).otherwise(none),
    ]


def verify(pairs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Each chunk's problems and warnings, and whether it passes; a chunk without a translation fails by that alone.
    files: doc_id and path of what exists; without it no file is looked for."""
    found = pairs
    if files is not None:
        found = found.join(files.groupBy("doc_id").agg(F.collect_set("path").alias("files")), "doc_id", "left")
        found = found.withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    every = F.concat(*problems(F.col("files") if files is not None else None))
    out = found.withColumn("problems", F.when(F.col("translation").isNull(), F.array(F.lit("no translation"))).otherwise(every)).withColumn("warnings", F.coalesce(missing_integers(), F.array().cast("array<string>")))
    return out.select("doc_id", "id", "problems", "warnings", (F.size("problems") == 0).alias("ok"))


def verdict(verified: DataFrame) -> DataFrame:
    return verified.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(~F.col("ok")).alias("failed"), F.bool_and("ok").alias("ok"))


def assemble(chunks: DataFrame, translations: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """One text for each document from its translated chunks in order, with its glossary. complete tells whether no chunk
    lacks a translation; only complete documents have a text."""
    parts = F.sort_array(F.collect_list(F.struct("id", T.strip(F.col("translation")).alias("t"))))
    found = chunks.select("doc_id", "id").join(translations.select("doc_id", "id", "translation"), ["doc_id", "id"], "left")
    done = found.groupBy("doc_id").agg(parts.alias("p"), F.bool_and(F.col("translation").isNotNull()).alias("complete"))
    body = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    if glossary is not None:
        done = done.join(glossary.select("doc_id", "glossary"), "doc_id", "left")
        appendix = F.concat(F.lit("\n\n---\n\n## 용어 대응표 (Glossary)\n\n"), T.strip(F.col("glossary")), F.lit("\n"))
        body = F.concat(body, F.coalesce(appendix, F.lit("")))
    return done.select("doc_id", "complete", F.when(F.col("complete"), F.concat(body, F.lit("\n"))).alias("text"))


def final_check(works: DataFrame) -> DataFrame:
    """The rows item, value, criterion and ok for each document of works: doc_id, source, ko (null: no text), html (null: none),
    files (paths that exist), chunks, translated, reviewed (counts, null without an index), coverage, truncated, extractor
    and figures (null without them). Some rows only inform."""
    ko = F.col("ko")
    ns, body = count_blocks(F.coalesce("source", F.lit(""))), ko
    at = F.regexp_instr(ko, F.lit(C.GLOSSARY))
    nt = count_blocks(F.when(at > 0, F.left(body, at - 1)).otherwise(body))
    years = T.missing(F.coalesce("source", F.lit("")), ko, C.YEAR)
    links = T.image_links(ko)
    broken = F.size(F.filter(links, lambda x: ~F.array_contains("files", x)))
    notes, left = F.size(untranslated_footnotes(ko)), F.size(untranslated_body(ko))
    inlined = F.regexp_count("html", F.lit("data:image"))
    plain = F.regexp_count("html", F.lit(r'<img[^>]+src="(?!data:)'))
    s = lambda c: c.cast("string")

    def row(item: str, value: Column, criterion: str, ok: Column, there: Column | None = None) -> Column:
        made = F.struct(F.lit(item).alias("item"), s(value).alias("value"), F.lit(criterion).alias("criterion"), ok.alias("ok"))
        return F.when(there, made) if there is not None else made

    has, true = ko.isNotNull(), F.lit(True)
    html, index, meta = F.col("html").isNotNull(), F.col("chunks").isNotNull(), F.col("coverage").isNotNull()
    rows = [
        row("translation", F.lit("none"), "required", F.lit(False), ~has),
        row("untranslated footnotes", notes, "0", notes == 0, has),
        row("untranslated paragraphs", left, "0", left == 0, has),
        row("paragraphs", F.concat(s(ns), F.lit("→"), s(nt)), "within 2 %", (ns == 0) | (F.abs(ns - nt) <= F.greatest(F.lit(2.0), ns * 0.02)), has),
        row("missing years", F.concat(s(F.size(years)), F.lit(" "), F.array_join(F.slice(years, 1, 5), ",")), "0", F.size(years) == 0, has),
        row("image links", F.concat(s(F.size(links)), F.lit(", broken "), s(broken)), "broken 0", broken == 0, has),
        row("html images", F.concat(s(inlined), F.lit(" / "), s(plain)), "all inlined", (plain == 0) & (inlined >= F.size(links)), has & html),
        row("html", F.lit("none"), "required", F.lit(False), has & ~html),
        row("files", F.concat_ws(" / ", s(F.col("chunks")), s(F.col("translated")), s(F.col("reviewed"))), "translated = chunks", F.col("translated") >= F.col("chunks"), has & index),
        row("chunks without review", F.col("chunks") - F.col("reviewed"), "0", true, has & index & (F.col("reviewed") < F.col("chunks"))),
        row("coverage", F.col("coverage"), "≥0.97", F.col("coverage") >= C.MIN_COVERAGE, has & meta),
        row("truncated", F.col("truncated"), "≤0.05", F.col("truncated") <= C.MAX_TRUNCATED, has & meta),
        row("extractor", F.coalesce("extractor", F.lit("?")), "-", true, has & meta),
        row("figures", F.coalesce("figures", F.lit(0)), "-", true, has & meta),
    ]
    return works.select("doc_id", F.posexplode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("n", "r")).select("doc_id", "n", "r.*")


def check_report(rows: DataFrame) -> DataFrame:
    """The Markdown table of final_check()'s rows, with the verdict and the failed items."""
    r = F.sort_array(F.collect_list(F.struct("n", "item", "value", "criterion", "ok")))
    found = rows.groupBy("doc_id").agg(r.alias("r"), F.bool_and("ok").alias("ok"))
    line = lambda x: F.concat(F.lit("| "), x["item"], F.lit(" | "), x["value"], F.lit(" | "), x["criterion"], F.lit(" | "), F.when(x["ok"], F.lit("ok")).otherwise(F.lit("FAIL")), F.lit(" |"))
    failed = F.transform(F.filter("r", lambda x: ~x["ok"]), lambda x: F.concat(F.lit("- "), x["item"], F.lit(": "), x["value"], F.lit(" ("), x["criterion"], F.lit(")")))
    head = F.concat(F.lit("# Final check\n\n"), F.when(F.col("ok"), F.lit("PASS")).otherwise(F.lit("FAIL")), F.lit("\n\n| item | value | criterion | verdict |\n|---|---|---|---|\n"))
    tail = F.when(F.col("ok"), F.lit("")).otherwise(F.concat(F.lit("\n## Failed\n\n"), F.array_join(failed, "\n"), F.lit("\n")))
    return found.select("doc_id", "ok", reduce(F.concat, [head, F.array_join(F.transform("r", line), "\n"), F.lit("\n"), tail]).alias("report"))
