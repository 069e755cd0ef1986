"""The steps from candidate texts and page lines to a checked translation, each on tables of all documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import text as T
from foliant.operators import checks, chunking, html, layout, links, paragraphs, quality, regions
from foliant.shared import cut, dealt
from foliant.sources import containers


class Processed(NamedTuple):
    """blocks: doc_id, idx, text. dropped: doc_id and the characters that were taken out on purpose."""

    blocks: DataFrame
    dropped: DataFrame


class Layout(NamedTuple):
    """What a document's pages say of its text, each table keyed by doc_id: the line sequence with paragraph starts, the
    norms of running heads, heading and size by first line, the body's size, regions, image links, each page's last key, and
    the characters that regions and running heads take out."""

    sequence: DataFrame
    heads: DataFrame
    headings: DataFrame
    sizes: DataFrame
    bodies: DataFrame
    regions: DataFrame
    images: DataFrame
    last: DataFrame
    gone: DataFrame


def layout_of(
    lines: DataFrame, pages: DataFrame, planned: DataFrame | None = None, images: DataFrame | None = None, tables: DataFrame | None = None, graphics: DataFrame | None = None
) -> Layout:
    """planned: regions as regions.plan gives them (doc_id, pno, box, kind, cap_text, anchor, link), or None: they are planned
    from the lines, the tables and the graphics (doc_id, pno, box). images: placed images (doc_id, pno, xref, box). Regions
    and lines are written once each, since several steps read them (foliant.shared)."""
    planned = cut(regions.plan(lines, pages, tables, graphics), "regions") if planned is None else planned
    repeated = paragraphs.repeated_norms(lines)
    flags = cut(layout.line_flags(layout.ordered_lines(lines, pages, repeated, planned), layout.READING), "lines")
    numbered = planned.withColumn("n", F.row_number().over(paragraphs.Window.partitionBy("doc_id").orderBy("pno", "y0", "x0")).cast("long"))
    if images is None:
        shown = numbered.select("doc_id", "pno", "n", "link").limit(0)
    else:
        shown = links.page_links(regions.outside(regions.pick_images(images, pages), planned)).select("doc_id", "pno", F.col("n").cast("long").alias("n"), "link")
    gone = paragraphs.repeated_chars(repeated).unionByName(regions.region_chars(lines, planned).withColumnRenamed("chars", "dropped"))
    return Layout(
        flags.select("doc_id", F.col("seq").alias("idx"), T.key(F.col("text")).alias("key"), "is_start"),
        repeated.groupBy("doc_id").agg(F.collect_set("norm").alias("norms")),
        flags.where("is_heading").select("doc_id", T.key(F.col("text")).alias("key0"), F.lit(True).alias("heading")).distinct(),
        layout.first_sizes(flags).withColumnRenamed("key", "key0"),
        layout.body_sizes(lines), numbered, shown, layout.page_last(flags), gone.groupBy("doc_id").agg(F.sum("dropped").alias("dropped")),
    )


def _processed(units: DataFrame, l: Layout) -> Processed:
    """Each text's blocks (doc_id, idx, text) set right by a layout whose tables have the same key."""
    paras = cut(paragraphs.rebuild_paragraphs(paragraphs.drop_images(units), l.sequence), "paragraphs")
    uncovered = paragraphs.drop_cover(paras)
    kept = paragraphs.drop_math(paragraphs.strip_running_heads(uncovered, l.heads))
    marked = paragraphs.mark_headings(kept.join(dealt(l.headings), ["doc_id", "key0"], "left").na.fill({"heading": False})).drop("heading")
    noted = marked.join(dealt(l.sizes), ["doc_id", "key0"], "left").join(dealt(l.bodies), "doc_id", "left")
    # Each step reads its blocks twice or more, so they are written between the steps.
    blocks = cut(paragraphs.merge_continuations(paragraphs.mark_footnotes(noted).select("doc_id", "idx", "text")), "blocks")
    blocks = cut(links.link_equations(blocks, l.regions), "blocks")
    blocks = cut(links.link_captions(blocks, l.regions.where(F.col("kind") != "equation")), "blocks")
    bare = l.regions.where(F.col("cap_text").isNull() & (F.col("kind") != "equation")).select("doc_id", "pno", F.lit(1).alias("kind"), "n", "link")  # a page's regions come after its images
    covers = paragraphs.mark_cover(units).where("cover").select("doc_id", F.lit(0).alias("pno")).distinct()
    shown = l.images.join(dealt(covers), ["doc_id", "pno"], "left_anti").select("doc_id", "pno", F.lit(0).alias("kind"), "n", "link")
    blocks = links.link_pages(blocks, bare.unionByName(shown), l.last)
    dropped = l.gone.unionByName(paragraphs.dropped_chars(paras, uncovered))
    return Processed(blocks, dropped.groupBy("doc_id").agg(F.sum("dropped").alias("dropped")))


def postprocess(units: DataFrame, lines: DataFrame, pages: DataFrame, planned: DataFrame | None = None, images: DataFrame | None = None, tables: DataFrame | None = None, graphics: DataFrame | None = None) -> Processed:
    """A candidate's blocks (doc_id, idx, text) set right by the lines of its pages (layout_of).

    Paragraphs are rebuilt, covers, running heads and formulas taken out, headings and notes marked, broken sentences joined,
    and links put where they belong: equations after the text above them, captioned regions before their caption, all others
    and the images at the end of their page; images of a cover page are left out.
    """
    return _processed(units, layout_of(lines, pages, planned, images, tables, graphics))


def postprocess_candidates(candidates: DataFrame, lines: DataFrame, pages: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """All candidates (doc_id, ord, name, text) of all documents set right at once, over one layout: candidates with their
    new texts, and the characters taken out on purpose, of each (doc_id, ord, dropped). how: as for postprocess."""
    one = F.struct("doc_id", "ord")
    ids = candidates.select("doc_id", "ord")

    def of_each(table: DataFrame) -> DataFrame:
        return table.join(dealt(ids), "doc_id").withColumn("doc_id", one).drop("ord")

    units = paragraphs.explode_units(candidates.select(one.alias("doc_id"), "text"))
    done = _processed(units, Layout(*map(of_each, layout_of(lines, pages, **how))))
    texts = paragraphs.assemble_text(done.blocks).select("doc_id.*", "text")
    made = candidates.drop("text").join(dealt(texts), ["doc_id", "ord"], "left").na.fill({"text": ""})
    return made.select("doc_id", "ord", "name", "text"), done.dropped.select("doc_id.*", "dropped")


def stitched(texts: DataFrame, planned: DataFrame | None = None, name: str = "stitched") -> tuple[DataFrame, DataFrame]:
    """The older extraction's texts (doc_id, text) as candidates for the fallback: cleaned, pages stitched, equations linked;
    and what was taken out of each (doc_id, ord, dropped)."""
    clean = texts.select("doc_id", T.clean(F.col("text")).alias("text"))
    blocks = paragraphs.explode_units(clean)
    made = paragraphs.assemble_text(paragraphs.stitch_pages(blocks))
    made = made if planned is None else add_equation_images(made, planned)
    dropped = paragraphs.dropped_chars(blocks, paragraphs.unrepeated(blocks)).select("doc_id", F.lit(0).alias("ord"), "dropped")
    return made.select("doc_id", F.lit(0).alias("ord"), F.lit(name).alias("name"), "text"), dropped


def add_equation_images(texts: DataFrame, planned: DataFrame) -> DataFrame:
    """texts (doc_id, text) of another extractor with the links of their pages' equations (of regions.plan), each after the
    first block that holds the line above it; those without one at the end. Texts without equations stay as they are."""
    numbered = planned.where(F.col("kind") == "equation").withColumn("n", F.row_number().over(paragraphs.Window.partitionBy("doc_id").orderBy("pno", "y0", "x0")).cast("long"))
    some = texts.join(dealt(numbered.select("doc_id").distinct()), "doc_id", "left_semi")
    blocks = some.select("doc_id", F.posexplode(F.filter(F.split("text", "\n\n"), lambda b: T.strip(b) != "")).alias("idx", "text"))
    made = paragraphs.assemble_text(links.link_equations(blocks, numbered))
    return made.unionByName(texts.join(dealt(numbered.select("doc_id").distinct()), "doc_id", "left_anti").select("doc_id", "text"))


def scored(candidates: DataFrame, raw: DataFrame, dropped: DataFrame | None = None, has_tables: DataFrame | None = None) -> DataFrame:
    """candidates (doc_id, ord, name, text) with their scores against raw (doc_id, text): cleaned, and whether tables are
    kept where the document has some (doc_id, has_tables). dropped: of each candidate (doc_id, ord, dropped), or of all of a
    document's (doc_id, dropped)."""
    clean, scores = _scored(candidates, raw, dropped, has_tables)
    return clean.join(dealt(scores.drop("name")), ["doc_id", "ord"])


def _scored(candidates: DataFrame, raw: DataFrame, dropped: DataFrame | None = None, has_tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The candidates cleaned, and their scores without texts. Cleaned texts are written once: their blocks, their sizes and
    the choice read them, and each would otherwise make the candidates anew. Scores take no texts along."""
    clean = cut(candidates.withColumn("text", T.clean(F.col("text"))), "candidates")
    one = F.struct("doc_id", "ord")
    blocks = paragraphs.explode_units(clean.select(one.alias("doc_id"), T.body_before_references(F.col("text")).alias("text")))
    measured = clean.select("doc_id", "ord", "name", T.norm_len(F.col("text")).alias("kept"), checks.count_table_rows(F.col("text")).alias("rows"))
    measured = cut(measured, "candidate-sizes")
    sizes = measured.join(dealt(raw.select("doc_id", T.norm_len(F.col("text")).alias("raw"))), "doc_id")
    sizes = sizes.join(dealt(dropped), [c for c in ("doc_id", "ord") if c in dropped.columns], "left") if dropped is not None else sizes.withColumn("dropped", F.lit(0))
    sized = sizes.select(one.alias("doc_id"), "kept", "raw", F.coalesce("dropped", F.lit(0)).alias("dropped"))
    found = quality.score(sized, quality.truncated(blocks)).select("doc_id.*", "coverage", "truncated", "ok")
    out = measured.select("doc_id", "ord", "name", "rows").join(dealt(found), ["doc_id", "ord"])
    if has_tables is None:
        return clean, out.drop("rows").withColumn("keeps_tables", F.lit(True))
    kept = ~F.coalesce("has_tables", F.lit(False)) | (F.col("rows") > 0)
    return clean, out.join(dealt(has_tables), "doc_id", "left").withColumn("keeps_tables", kept).drop("has_tables", "rows")


def extract(candidates: DataFrame, raw: DataFrame, fallback: DataFrame | None = None, force: bool = False, dropped: DataFrame | None = None, has_tables: DataFrame | None = None, fallback_dropped: DataFrame | None = None) -> DataFrame:
    """The chosen text of each document, with name, scores and gate_ok. fallback: candidates (doc_id, ord, name, text) that
    count only where the best one does not pass, and is worse; tables do not matter there. force waives cut paragraphs, not
    lost text. Each candidate is scored with its own dropped characters."""
    every, scores = _scored(candidates, raw, dropped, has_tables)
    best, every = quality.tournament(scores), every.select("doc_id", "name", "text")
    if fallback is not None:
        other, scores = _scored(fallback, raw, fallback_dropped)
        best, every = quality.with_fallback(best, scores), every.unionByName(other.select("doc_id", "name", "text"))
    return quality.gate(best.select("doc_id", "name", "coverage", "truncated", "ok"), force).join(dealt(every), ["doc_id", "name"])


def meta(extracted: DataFrame) -> DataFrame:
    """One row a document: characters, figures, notes, extractor and scores to four places."""
    t = F.col("text")
    figures, notes = F.size(T.image_links(t)), F.size(F.filter(T.units(t), lambda u: F.startswith(u, F.lit("> **각주"))))
    return extracted.select("doc_id", F.length(t).alias("chars"), figures.alias("figures"), notes.alias("footnotes"), F.col("name").alias("extractor"), F.round("coverage", 4).alias("coverage"), F.round("truncated", 4).alias("truncated"))


def chunk(extracted: DataFrame, max_chars: int = C.CHUNK_CHARS) -> DataFrame:
    return chunking.chunks(chunking.split_sections(extracted.select("doc_id", "text")), max_chars)


def verify(chunks: DataFrame, translations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    pairs = chunks.select("doc_id", "id", F.col("text").alias("source")).join(translations.select("doc_id", "id", F.col("text").alias("translation")), ["doc_id", "id"], "left")
    return checks.verify(pairs, files)


def assemble(chunks: DataFrame, translations: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    return checks.assemble(chunks, translations.withColumnRenamed("text", "translation"), glossary)


def render_html(merged: DataFrame, images: DataFrame | None = None) -> DataFrame:
    made = html.render(merged.where(F.col("text").isNotNull()))
    return html.embed_images(made, images) if images is not None else made


final_check = checks.final_check


def artefacts(extracted: DataFrame, chunks: DataFrame, merged: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """What the steps made, as rows (doc_id, kind, name, content): source, meta, chunks and their index, the merged text and
    its page (doc_id, html)."""
    row = lambda df, kind, content, name="": df.select("doc_id", F.lit(kind).alias("kind"), (F.lit(name) if isinstance(name, str) else name).alias("name"), content.alias("content"))
    m = meta(extracted)
    parts = [
        row(extracted, "source", F.col("text")), row(m, "meta", F.to_json(F.struct(*[c for c in m.columns if c != "doc_id"]))), row(chunks, "chunk", F.col("text"), F.col("id")),
        row(chunking.index_json(chunking.chunk_index(chunks)), "index", F.col("json")), row(merged, "merged", F.col("text")),
    ]
    if pages is not None:
        parts.append(row(pages, "page", F.col("html")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write(extracted: DataFrame, chunks: DataFrame, merged: DataFrame, target: str) -> int:
    """Commits what the steps made to the containers of target (sources.containers), and gives the version."""
    return containers.write_documents(artefacts(extracted, chunks, merged), target)
