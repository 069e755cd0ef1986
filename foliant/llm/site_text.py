"""Main text of web pages: element subtrees that recur across the pages of a site are its template, and are deleted."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut
from foliant.ship import map_arrow

#: Recurring subtrees (8 bytes each) up to which they go to all workers at once; beyond it they are joined.
SENT = 2_000_000
#: Parts that a recurring subtree is dealt to where they are joined, so that a site's menu is no hot key.
PARTS = 32

#: Nothing is tried in two ways, so that broken markup takes no longer.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Never part of an article.
GONE = RAW | frozenset("head nav header footer aside form noscript template object svg canvas audio video select option button dialog menu datalist".split())
#: Elements that end no block.
FLOWING = INLINE | RAW | frozenset("noscript template select option button datalist".split())
#: In an article only these are template when they recur: a paragraph that several articles share is text.
CONTAINERS = frozenset("div section aside nav header footer form ul ol dl table figure details center".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that opens closes open ones of these tags, up to the tags that bound them.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
} | {t: (frozenset(["p"]), frozenset(["button", "td", "th", "li", "div", "section", "article", "main", "body", "blockquote"])) for t in ENDS_P}
#: Words of class, id and role that name what is no article.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs
    masthead header footer contentinfo complementary comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal
    newsletter subscribe subscription share sharing social related recommended widget login signup search form pagination pager toolbar""".split()
)
#: Words that say of an element that it only stands beside such a one, or titles an article.
BESIDE = frozenset("has with no without is article entry post title".split())


@dataclass
class Page:
    """The elements of a page in order: tag, parent (-1: none), whether their names say that they are no article, and a hash
    of the subtree. pieces: (element, text or None for the border of a block)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    named: list[bool] = field(default_factory=list)
    hashes: list[bytes] = field(default_factory=list)
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether class, id and role name no article, and whether they name the main part."""
    found, main = False, False
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        for word in (a or b or c).lower().split():
            main |= kind.lower() == "role" and word == "main"
            if tag in ("article", "main"):
                found |= word in NAMES
            else:
                parts = set(re.split(r"[^a-z]+", word))
                found |= bool(parts & NAMES) and not parts & BESIDE
    return found and tag not in ("html", "body"), main


def parse(source: str, site: bytes = b"") -> Page:
    """The elements of a page as a browser would nest them, in one pass. Tags left open are closed by what may not stand in
    them, or at the end. Hashes are of tag, class, text and children, and of the site."""
    page = Page()
    made: list[list[bytes]] = [[]]
    stack: list[int] = []
    names: list[bytes] = []
    salt = hashlib.blake2b(site, digest_size=16).digest()

    def close() -> None:
        k = stack.pop()
        parts = made.pop()
        digest = hashlib.blake2b(b"\x00".join([names[k], *parts]), digest_size=8, key=salt).digest()
        page.hashes[k] = digest
        made[-1].append(digest)
        if page.tags[k] not in FLOWING:
            page.pieces.append((stack[-1] if stack else -1, None))

    def text(upto: int) -> None:
        if upto > at:
            t = source[at:upto]
            page.pieces.append((stack[-1] if stack else -1, t))
            made[-1].append(" ".join(t.split()).encode("utf-8", "surrogatepass"))

    at, end = 0, len(source)
    tagged = source.rfind(">") + 1  # after it there are no tags, and none are looked for
    while at < end:
        m = TOKEN.search(source, at, tagged)
        if m is None:
            open_comment = source.find("<!--", at)
            text(end if open_comment < 0 else open_comment)
            break
        text(m.start())
        at = m.end()
        if at == tagged and m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "p" and not any(page.tags[k] == "p" for k in stack):
                page.pieces.append((stack[-1] if stack else -1, None))
            for depth in range(len(stack) - 1, -1, -1):
                if page.tags[stack[depth]] == tag:
                    while len(stack) > depth:
                        close()
                    break
                if tag in INLINE and page.tags[stack[depth]] not in INLINE:
                    break  # an inline end tag closes no block
            continue
        shut, bound = CLOSES.get(tag, (None, None))
        if shut:
            for depth in range(len(stack) - 1, -1, -1):
                over = page.tags[stack[depth]]
                if over in bound:
                    break
                if over in shut:
                    while len(stack) > depth:
                        close()
        if tag in VOID:
            page.pieces.append((stack[-1] if stack else -1, " " if tag in INLINE else None))
            continue
        named, main = _named(tag, m[3] or m[6] or "")
        k = len(page.tags)
        page.tags.append("main" if main and tag != "article" else tag)
        page.parents.append(stack[-1] if stack else -1)
        page.named.append(named)
        page.hashes.append(b"")
        names.append(tag.encode("utf-8", "surrogatepass") + b"".join(v.encode("utf-8", "surrogatepass") for kind, *vs in ATTRIBUTE.findall(m[3] or m[6] or "") if kind.lower() == "class" for v in vs))
        if tag not in FLOWING:
            page.pieces.append((k, None))
        stack.append(k)
        made.append([])
        if tag in RAW:
            shut_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = shut_at.start() if shut_at else end
            if not shut_at:
                break
    while stack:
        close()
    return page


def outline(page: Page, template: set[int] = frozenset()) -> tuple[list[bool], list[bool]]:
    """Which elements are deleted, and which belong to the main part: the outermost articles that are left, else the main
    elements, else all. template: elements to delete besides those whose tag or names say so. What holds an article or a
    main element is not deleted for its class or as template."""
    n = len(page.tags)
    holds = [t in ("article", "main") and not x for t, x in zip(page.tags, page.named, strict=True)]
    for k in range(n - 1, -1, -1):
        if holds[k] and page.parents[k] >= 0:
            holds[page.parents[k]] = True
    gone = [False] * n
    for k, tag in enumerate(page.tags):
        up = page.parents[k]
        gone[k] = (up >= 0 and gone[up]) or tag in GONE or (page.named[k] and not holds[k]) or (k in template and not holds[k])
    for root in ("article", "main", None):
        within = [root is None] * n
        for k, tag in enumerate(page.tags):
            up = page.parents[k]
            within[k] = within[k] or (up >= 0 and within[up]) or (tag == root and not gone[k])
        if root is None or any(within):
            return gone, within
    return gone, [True] * n


def blocks(page: Page, gone: list[bool], within: list[bool]) -> list[str]:
    """The texts of the main part's blocks in page order, character references decoded, white space made one space."""
    out, held = [], []
    whole = all(within)

    def flush() -> None:
        if held:
            t = "".join(held)
            if t := " ".join((entities.unescape(t) if "&" in t else t).split()):
                out.append(t)
            held.clear()

    for k, t in page.pieces:
        inside = (within[k] and not gone[k]) if k >= 0 else whole
        if t is None:
            if inside or held:
                flush()
        elif inside:
            held.append(t)
    flush()
    return out


def candidates(page: Page) -> tuple[list[int], int]:
    """The elements that are template if they recur, and a hash of the longest block, which tells pages of one text from
    pages that share a template."""
    gone, within = outline(page)
    found = blocks(page, gone, within)
    longest = max(found, key=len, default="")
    whole = all(within)
    some = [k for k, t in enumerate(page.tags) if t not in INLINE and t not in ("html", "head", "body") and t not in RAW and (whole or not within[k] or t in CONTAINERS)]
    return some, int.from_bytes(hashlib.blake2b(longest.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        subtree, content = [], []
        for site, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = parse(source or "", site.encode())
            some, longest = candidates(page)
            found = {page.hashes[k] for k in some}
            subtree += map(_number, found)
            content += [longest] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(subtree, pa.int64()), pa.array(content, pa.int64())], ["subtree", "content"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, element, subtree = [], [], []
        for u, site, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            page = parse(source or "", site.encode())
            some = candidates(page)[0]
            uid += [u] * len(some)
            element += some
            subtree += [_number(page.hashes[k]) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(element, pa.int32()), pa.array(subtree, pa.int64())], ["uid", "element", "subtree"])


def _extract(recurring: np.ndarray | None):
    """columns, __site, __html (and __template, elements to delete, where recurring is None) made columns and __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if recurring is None else set(recurring.value.tolist())
        for batch in batches:
            texts = []
            at = batch.schema.get_field_index
            given = batch.column(at("__template")).to_pylist() if known is None else [None] * batch.num_rows
            for site, source, elements in zip(batch.column(at("__site")).to_pylist(), batch.column(at("__html")).to_pylist(), given, strict=True):
                page = parse(source or "", site.encode())
                template = set(elements or ()) if known is None else {k for k in candidates(page)[0] if _number(page.hashes[k]) in known}
                texts.append("\n".join(blocks(page, *outline(page, template))))
            keep = [k for k, f in enumerate(batch.schema) if f.name not in ("__site", "__html", "__template")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(texts, pa.string())], [*[batch.schema.field(k).name for k in keep], "__text"])

    return run


def recurring_subtrees(pages: DataFrame, least: int = 5, url: str = "url", html: str = "html") -> DataFrame:
    """subtree: the hashes (with their site's) of elements that stand on least or more pages of a site whose longest blocks
    differ. Copies of one article count as one page. Sites of any size are counted by subtree, map-side first."""
    found = map_arrow(_sited(pages, url, html).select("__site", "__html"), _subtrees, "subtree long, content long")
    return found.groupBy("subtree", "content").agg(F.lit(1).alias("one")).groupBy("subtree").agg(F.count("*").alias("pages")).where(F.col("pages") >= least).select("subtree")


def _sited(pages: DataFrame, url: str, html: str) -> DataFrame:
    site = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("__site", site).withColumn("__html", F.coalesce(F.col(html), F.lit("")))


def main_text(pages: DataFrame, least: int = 5, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html", sent: int = SENT) -> DataFrame:
    """The columns keep and text: the article of each page, its blocks joined by line feeds.

    Deleted are elements that recur on least pages of their site (recurring_subtrees), and those whose tag, class, id or role
    says that they are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments of readers.
    Inside an article recurring paragraphs, headings and cells of text stay; only containers go. Null and empty pages have
    an empty text; a null url, or one without a host, is one site of its own; repeated rows count once as template and stay
    as rows; pages may be of any length; an empty table gives no rows. Other columns are not read.

    The recurring subtrees go to all workers while they are at most sent (8 bytes each); beyond it pages are numbered in a
    written table, their elements joined with the recurring ones, dealt to PARTS parts each, and the elements to delete
    brought back by number.
    """
    spark = pages.sparkSession
    recurring = cut(recurring_subtrees(pages, least, url, html), "recurring")
    rows = _sited(pages, url, html).select(*keep, "__site", "__html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", __text string"
    if recurring.count() <= sent:
        known = np.array([r["subtree"] for r in recurring.collect()], np.int64)
        out = map_arrow(rows, _extract(spark.sparkContext.broadcast(known)), schema)
    else:
        numbered = cut(rows.withColumn("__uid", F.monotonically_increasing_id()), "pages")
        posted = map_arrow(numbered.select("__uid", "__site", "__html"), _posted, "uid long, element int, subtree long").withColumn("part", F.pmod("uid", F.lit(PARTS)))
        parts = recurring.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("part", F.col("part").cast("long"))
        template = posted.join(parts, ["subtree", "part"]).groupBy("uid").agg(F.collect_list("element").alias("__template"))
        found = numbered.join(template, numbered["__uid"] == template["uid"], "left").drop("uid", "__uid")
        out = map_arrow(found, _extract(None), schema)
    return out.select(*keep, F.col("__text").alias("text"))
