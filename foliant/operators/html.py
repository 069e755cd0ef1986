"""Markdown to HTML and back to blocks, titles, and images inside HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T

IMG = r'<img[^>]+src="([^"]+)"'
#: HTML entities that texts hold.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
PAGE = '<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>%s</title></head><body>\n%s\n</body></html>\n'


def markdown_title(c: Column, otherwise: Column) -> Column:
    found = F.regexp_extract(c, r"(?dm)^#\s+(.+)$", 1)
    return F.when(found != "", T.strip(found)).otherwise(otherwise)


def page_title(html: Column) -> Column:
    return unescape(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))


def unescape(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def image_counts(html: Column) -> tuple[Column, Column]:
    """Images inside the page, and those that it only names."""
    return F.regexp_count(html, F.lit("data:image")), F.regexp_count(html, F.lit(r'<img[^>]+src="(?!data:)'))


def html_blocks(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """The blocks of a page's article as Markdown texts: headings, paragraphs (line breaks kept), list items."""
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(article != "", article).otherwise(F.col(html))
    body = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?i)<br\s*/?>", "\n")
    marked = F.regexp_replace(F.regexp_replace(body, r"(?i)<h([1-6])[^>]*>", "\u0001#$1 "), r"(?i)<li[^>]*>", "\u0001- ")
    marked = F.regexp_replace(marked, r"(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|blockquote)[^>]*>", "\u0001")
    parts = F.filter(F.transform(F.split(F.regexp_replace(marked, "<[^>]+>", ""), "\u0001"), lambda x: T.strip(unescape(x))), lambda x: ~x.isin("", "-"))
    head = lambda x: F.when(x.rlike(r"^#[1-6] "), F.concat(F.repeat(F.lit("#"), F.substring(x, 2, 1).cast("int")), F.substring(x, 3, 1 << 30))).otherwise(x)
    return pages.select(key, F.posexplode(F.transform(parts, head)).alias("idx", "text"))


#: Lists in lists; deeper ones stay at the last level.
LEVELS = 6
TOKENS = r"<[^>]+>|[^<]+"
#: Tags at which another block begins, outside tables.
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "article", "section", "blockquote", "pre", "hr", "header", "footer", "nav", "main", "aside", "figure", "body", "dl", "dt", "dd")
ROW, CELL = "\u0002", "\u0001"


def to_markdown(pages: DataFrame, html: str = "html", key: str = "page_id", folder: str = "images") -> DataFrame:
    """The blocks of HTML texts as Markdown: key, idx and text. Headings, paragraphs, quotations, nested lists with numbers,
    tables (the first row is the head), code, rules; in them links, emphasis, code and pictures, which are numbered in a
    page: fig_001.png, with jpg for jpeg.

    Tags and the texts between them are rows. What a text stands in is a running count of opened less closed tags, so lists
    nest; of each level the list and the item that were opened last are kept. Null and empty texts have no blocks; tags that
    close nothing are let be; scripts, styles and comments are left out.
    """
    order = Window.partitionBy(key).orderBy("pos")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style|head|title)(?:\s[^>]*)?>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(bare, F.lit(TOKENS), F.lit(0))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    rows = rows.withColumn("name", name).withColumn("shut", F.startswith("token", F.lit("</")))
    opens = lambda *names: F.col("name").isin(*names) & ~F.col("shut")
    shuts = lambda *names: F.col("name").isin(*names) & F.col("shut")
    count = lambda c: F.sum(c.cast("int")).over(sofar)
    stands = {"lists": ("ul", "ol"), "tables": ("table",), "pre": ("pre",), "quotes": ("blockquote",)}
    rows = rows.withColumns({c: F.sum(F.when(opens(*names), 1).when(shuts(*names), -1).otherwise(0)).over(sofar) for c, names in stands.items()})
    held = lambda c: (F.col(c) - F.least(F.min(c).over(sofar), F.lit(0))).cast("int")  # noqa: E731  an end tag without a beginning counts for nothing
    latest = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(sofar)
    attribute = lambda a: F.regexp_extract("token", rf"(?i)\s{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    rows = rows.withColumns({
        "depth": F.least(held("lists"), F.lit(LEVELS)), "tables": held("tables"), "pre": held("pre") > 0, "quotes": held("quotes"), "images": count(opens("img")), "href": latest(opens("a"), attribute("href")),
    })
    levels = range(LEVELS + 1)
    level = lambda k: F.col("depth") == k
    # Items so far of each level, and of its list those before the list: their difference numbers an item, without a sort by lists.
    rows = rows.withColumn("counted", F.array(*[F.sum((opens("li") & level(k)).cast("int")).over(sofar) for k in levels]))
    here = lambda c: F.element_at(c, F.col("depth") + 1)
    rows = rows.withColumn("lists", F.array(*[latest(opens("ul", "ol") & level(k), F.struct((F.col("name") == "ol").alias("ordered"), F.element_at("counted", k + 1).alias("before"))) for k in levels]))
    rows = rows.withColumn("items", F.array(*[latest(opens("li") & level(k) & F.lit(k > 0), F.col("pos")) for k in levels]))
    rows = rows.withColumn("list", here("lists")).withColumn("item", here("items")).withColumn("nth", here("counted") - F.coalesce("list.before", F.lit(0)))
    rows = rows.withColumn("ordered", F.col("list.ordered")).drop("lists", "items", "counted", "list")
    border = (F.col("name").isin(*BLOCK_TAGS) & (F.col("tables") == 0)) | opens("table") & (F.col("tables") == 1) | shuts("table")
    kind = F.regexp_extract("src", r"(?i)\.([a-z0-9]+)(?:[?#].*)?$", 1)
    extension = F.when(kind == "", "png").otherwise(F.regexp_replace(F.lower(kind), "^jpeg$", "jpg"))
    picture = F.concat(F.lit("!["), attribute("alt"), F.lit(f"]({folder}/fig_"), F.format_string("%03d", "images"), F.lit("."), extension, F.lit(")"))
    text = F.when(F.col("pre"), unescape(F.col("token"))).otherwise(F.regexp_replace(unescape(F.col("token")), r"\s+", " "))
    piece = (
        F.when(F.col("name") == "", F.when(F.startswith("token", F.lit("<")), "").otherwise(text))
        .when(F.col("name") == "br", "\n").when(F.col("name").isin("b", "strong"), "**").when(F.col("name").isin("i", "em"), "*")
        .when((F.col("name") == "code") & ~F.col("pre"), "`").when(opens("img"), picture)
        .when(opens("a") & (F.col("href") != ""), "[").when(shuts("a") & (F.col("href") != ""), F.concat(F.lit("]("), F.col("href"), F.lit(")")))
        .when((F.col("tables") > 0) & opens("tr"), ROW).when((F.col("tables") > 0) & opens("td", "th"), CELL)
        .when((F.col("tables") > 0) & F.col("name").isin(*BLOCK_TAGS), " ").when(opens("hr"), "---").otherwise("")
    )
    rows = rows.withColumn("src", F.when(opens("img"), attribute("src"))).withColumn("piece", piece).withColumn("block", F.sum(border.cast("int") + opens("hr").cast("int")).over(sofar) - opens("hr").cast("int"))
    heading = F.max(F.when(opens("h1", "h2", "h3", "h4", "h5", "h6"), F.substring("name", 2, 1).cast("int")))
    first = lambda c: F.min_by(c, "pos").alias(c)
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    blocks = rows.groupBy(key, "block").agg(shown.alias("text"), heading.alias("heading"), F.max("tables").alias("tables"), F.bool_or("pre").alias("pre"), F.max("quotes").alias("quotes"), *[first(c) for c in ("depth", "ordered", "item", "nth")])
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r" *\n *", "\n")

    def table(c: Column) -> Column:
        made = F.filter(F.transform(F.split(c, ROW), lambda r: F.transform(F.slice(F.split(r, CELL), 2, 1 << 20), lambda v: F.replace(F.regexp_replace(trim(v), r"\s+", " "), F.lit("|"), F.lit("\\|")))), lambda r: F.size(r) > 0)
        line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
        return F.array_join(F.flatten(F.transform(made, lambda r, k: F.when(k == 0, F.array(line(r), line(F.transform(r, lambda _: F.lit("---"))))).otherwise(F.array(line(r))))), "\n")

    is_table = F.contains("text", F.lit(ROW))
    code = F.concat(F.lit("```\n"), F.regexp_replace("text", r"^\n|\s+$", ""), F.lit("\n```"))
    body = F.when(is_table, table(F.col("text"))).when(F.col("pre"), code).otherwise(trim(F.col("text")))
    blocks = blocks.withColumn("body", body).where(F.regexp_replace("text", r"[\s*`\x01\x02]+", "") != "")
    # The first block of an item has its mark, what follows in it is set under it.
    # A level's items come one after another, so a block is its item's first unless the level's last block before it is of the same.
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("earlier", F.element_at(F.array(*[F.last(F.when(level(k), F.col("item")), ignorenulls=True).over(before) for k in levels]), F.col("depth") + 1))
    marked = F.col("item").isNotNull() & ~F.col("item").eqNullSafe(F.col("earlier"))
    mark = F.when(F.col("ordered"), F.concat(F.col("nth").cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    indent = F.when(F.col("depth") > 0, F.repeat(F.lit("    "), F.col("depth") - F.when(marked, 1).otherwise(0))).otherwise(F.lit(""))
    front = F.concat(F.when(F.col("quotes") > 0, F.repeat(F.lit("> "), F.col("quotes"))).otherwise(F.lit("")), indent, F.when(marked, mark).otherwise(F.lit("")), F.when(F.col("heading").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "))).otherwise(F.lit("")))
    rest = F.concat(F.repeat(F.lit("> "), F.col("quotes")), F.repeat(F.lit("    "), F.col("depth")))
    text = F.concat(front, F.replace("body", F.lit("\n"), F.concat(F.lit("\n"), rest)))
    return blocks.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1).alias("idx"), text.alias("text"))


#: Picture, link, code and emphasis of escaped text, and what they become. No pattern looks around itself.
MARKS = (
    (r"!\[([^\]]*)\]\(([^)\s]+)\)", '<img alt="$1" src="$2">'),
    (r"\[([^\]]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>'),
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"\*\*([^\s*](?:[^*]*[^\s*])?)\*\*", "<strong>$1</strong>"),
    (r"(^|[^*\w])\*([^\s*](?:[^*]*[^\s*])?)\*($|[^*\w])", "$1<em>$2</em>$3"),
    (r"(^|[^_\w])_([^\s_](?:[^_]*[^\s_])?)_($|[^_\w])", "$1<em>$2</em>$3"),
)
#: How a line begins that is more than text, by kind, the first that fits; lists may be indented.
KINDS = (("head", r"^#{1,6}\s"), ("rule", r"^(-{3,}|\*{3,}|_{3,})\s*$"), ("quote", r"^>"), ("table", r"^\|"), ("item", r"^\s*([-*+]|\d+[.)])\s"))

def _inline(c: Column) -> Column:
    for pattern, put in MARKS:
        c = F.regexp_replace(c, pattern, put)
    return c


def line_states(docs: DataFrame) -> DataFrame:
    """The lines of Markdown texts (doc_id, text) that show, with their state: doc_id, line, text, kind (code, head, rule,
    quote, table, item, text, or more: text that goes on an item), first and last (of their block), nth (in it), depth and
    ordered (of items and what goes on them), and below, the depth of the next line if it is of the same list, else 0.

    A line of three backquotes opens or ends code, as its number is odd or even; in code, blank lines are lines. A blank
    line ends every other block, and so does a line of another kind.
    """
    order = Window.partitionBy("doc_id").orderBy("line")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("line", "text"))
    fence = F.col("text").rlike(r"^```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(sofar))
    kind = F.lit("text")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    kind = F.when(fence, F.when(F.col("fences") % 2 == 1, "open").otherwise("shut")).when(F.col("fences") % 2 == 1, "code").when(T.strip(F.col("text")) == "", "blank").otherwise(kind)
    rows = rows.withColumn("kind", kind)
    # Text that follows an item, or text that does, goes on it.
    broken = F.col("kind") != "text"
    led = F.last(F.when(broken, F.col("kind")), ignorenulls=True).over(sofar)
    rows = rows.withColumn("kind", F.when((F.col("kind") == "text") & (led == "item"), "more").otherwise(F.col("kind")))
    class_ = F.when(F.col("kind") == "more", "item").otherwise(F.col("kind"))
    rows = rows.withColumn("class", class_).withColumn("before", F.lag("class").over(order))
    alone = F.col("class").isin("head", "rule", "open", "shut", "blank")
    rows = rows.withColumn("block", F.sum(F.coalesce((alone | (F.col("class") != F.col("before"))).cast("int"), F.lit(1))).over(sofar))
    inside = Window.partitionBy("doc_id", "block").orderBy("line")
    within = inside.rowsBetween(Window.unboundedPreceding, 0)
    item = F.col("kind") == "item"
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("items", F.sum(item.cast("int")).over(within))
    # An item stands two blanks deeper than its list, and at most one level below the item before it: the least of all raw
    # depths so far, each with the items since.
    raw = F.when(item, F.when(F.col("items") == 1, 1).otherwise(1 + F.floor(F.length(F.regexp_extract("text", r"^(\s*)", 1)) / 2)))
    least = F.min(raw - F.col("items")).over(within) + F.col("items")
    rows = rows.withColumn("depth", F.when(F.col("class") == "item", F.least(least, F.lit(LEVELS)).cast("int")))
    ordered = F.when(item, F.col("text").rlike(r"^\s*\d"))
    rows = rows.withColumn("ordered", F.last(ordered, ignorenulls=True).over(within))
    rows = rows.withColumn("last", F.lead("line").over(inside).isNull()).withColumn("goes_on", F.coalesce(F.lead("kind").over(inside) == "more", F.lit(False)))
    rows = rows.withColumn("below", F.coalesce(F.lead("depth").over(inside), F.lit(0))).withColumn("above", F.coalesce(F.lag("depth").over(inside), F.lit(0)))
    dashes = F.col("text").rlike(r"^\|?[\s:|-]*-[\s:|-]*$")
    rows = rows.withColumn("headed", (F.col("kind") == "table") & F.coalesce(F.lead(dashes).over(inside), F.lit(False)) & (F.col("nth") == 1))
    rows = rows.withColumn("dashes", (F.col("kind") == "table") & dashes & (F.col("nth") == 2))
    # The kind of list at each level is that of the item that opened it: the last one that stood there deeper than the one before.
    opens = item & (F.col("depth") > F.col("above"))
    levels = [F.last(F.when(opens & (F.col("depth") == k), F.col("ordered")), ignorenulls=True).over(within) for k in range(1, LEVELS + 1)]
    return rows.withColumn("lists", F.array(*[F.when(x, "ol").otherwise("ul") for x in levels]))


def render(docs: DataFrame) -> DataFrame:
    """HTML of Markdown texts (doc_id, text), with a title: headings, quotations, nested lists, tables with a head where a
    row of dashes follows, fenced code with blank lines, rules, paragraphs; in them pictures, links, code and emphasis.

    Each line becomes its own piece, by its state and its neighbours' (line_states), and pieces are joined in order. A null
    text gives an empty page, with the document's id as title."""
    filled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = line_states(filled).where(~F.col("kind").isin("blank") & ~F.col("dashes"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    first, last = F.col("nth") == 1, F.col("last")
    t = escape(F.col("text"))
    opened = lambda name, c: F.concat(F.when(first, F.lit(f"<{name}>")).otherwise(F.lit("")), c, F.when(last, F.lit(f"</{name}>")).otherwise(F.lit("")))
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)).cast("string")
    head = F.concat(F.lit("<h"), level, F.lit(">"), _inline(T.strip(F.regexp_replace(t, r"^#{1,6}\s+", ""))), F.lit("</h"), level, F.lit(">"))
    cells = F.transform(F.split(F.regexp_replace(T.strip(t), r"^\||\|$", ""), r"\|"), lambda v: _inline(T.strip(v)))
    row = lambda name: tag("tr", F.array_join(F.transform(cells, lambda v: tag(name, v)), ""))
    cell_rows = F.when(F.col("headed"), row("th")).otherwise(row("td"))
    table_ends = last | (F.col("headed") & (F.col("rows") == 2))
    table = F.concat(F.when(first, F.lit("<table>")).otherwise(F.lit("")), cell_rows, F.when(table_ends, F.lit("</table>")).otherwise(F.lit("")))
    depth, below = F.col("depth"), F.col("below")
    own = lambda d: F.element_at("lists", d)
    said = F.concat(F.when(F.col("kind") == "item", F.concat(F.when(depth > F.col("above"), F.concat(F.lit("<"), own(depth), F.lit(">"))).otherwise(F.lit("")), F.lit("<li>"))).otherwise(F.lit("")), _inline(T.strip(F.regexp_replace(t, r"^\s*([-*+]|\d+[.)])\s+", ""))))
    more = _inline(T.strip(t))
    down = lambda to: F.array_join(F.transform(F.when(depth > to, F.reverse(F.sequence(to + 1, depth))).otherwise(F.array().cast("array<int>")), lambda d: F.concat(F.lit("</"), own(d), F.when((d == 1) & (to == 0), F.lit(">")).otherwise(F.lit("></li>")))), "")
    shut = F.when(F.col("goes_on") | (below > depth), F.lit("")).otherwise(F.concat(F.lit("</li>"), down(below)))
    piece = (
        F.when(F.col("kind") == "head", head).when(F.col("kind") == "rule", F.lit("<hr>"))
        .when(F.col("kind") == "quote", opened("blockquote", _inline(F.regexp_replace(t, r"^&gt;\s?", ""))))
        .when(F.col("kind") == "table", table).when(F.col("kind") == "item", F.concat(said, shut)).when(F.col("kind") == "more", F.concat(more, shut))
        .when(F.col("kind") == "open", F.concat(F.lit("<pre><code>"), F.when(F.col("unclosed"), F.lit("</code></pre>")).otherwise(F.lit(""))))
        .when(F.col("kind") == "shut", F.lit("</code></pre>"))
        .when(F.col("kind") == "code", F.concat(t, F.when(F.col("unclosed"), F.lit("</code></pre>")).otherwise(F.lit("")))).otherwise(opened("p", _inline(t)))
    )
    order = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("rows", F.count("*").over(Window.partitionBy("doc_id", "block")) + F.when(F.col("headed"), 1).otherwise(0))
    lines = lines.withColumn("unclosed", F.lead("line").over(order).isNull()).withColumn("piece", piece)
    # A line begins anew, but for rows and items that go on, code's first line, and its end.
    after_open = F.lag("kind").over(order) == "open"
    joined = (F.col("kind").isin("table", "item") & ~first) | (F.col("kind") == "shut") | F.coalesce(after_open, F.lit(False)) | (F.lag("line").over(order).isNull())
    lines = lines.withColumn("piece", F.when(joined, F.col("piece")).otherwise(F.concat(F.lit("\n"), F.col("piece"))))
    bodies = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "piece"))), lambda x: x["piece"]), "").alias("body"))
    title = markdown_title(F.col("text"), F.col("doc_id").cast("string"))
    return filled.join(bodies, "doc_id", "left").select("doc_id", F.format_string(PAGE, escape(title), F.coalesce("body", F.lit(""))).alias("html"))


def embed_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages (doc_id, html; one row each) with the images (doc_id, path, mime, content) that exist as data; others stay as
    they are. Of several rows of one path the least counts; without a mime an image is a PNG.

    A page is split at its sources, each piece meets its one image by (doc_id, path), and the pieces are put together in
    order: a page's images are never all in one row before they stand in it."""
    mime = F.coalesce("mime", F.lit("image/png"))
    held = images.where(F.col("content").isNotNull()).groupBy("doc_id", "path").agg(F.min(F.struct(mime.alias("mime"), "content")).alias("i"))
    held = held.select("doc_id", "path", F.concat(F.lit("data:"), F.col("i.mime"), F.lit(";base64,"), F.base64("i.content")).alias("data"))
    whole = IMG.replace("(", "(?:").replace("[^", "[^")
    tags = F.concat(F.regexp_extract_all("html", F.lit(whole), F.lit(0)), F.array(F.lit("")))
    parts = pages.select("doc_id", F.split("html", whole, -1).alias("before"), tags.alias("tag"))
    pieces = parts.select("doc_id", F.posexplode(F.arrays_zip("before", "tag")).alias("n", "p"))
    pieces = pieces.select("doc_id", "n", "p.before", "p.tag", F.regexp_extract("p.tag", IMG, 1).alias("path"))
    put = pieces.join(held, ["doc_id", "path"], "left").withColumn("tag", F.when(F.col("data").isNotNull() & (F.col("path") != ""), F.replace("tag", F.col("path"), F.col("data"))).otherwise(F.col("tag")))
    text = F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat("before", "tag").alias("t")))), lambda x: x["t"])
    return put.groupBy("doc_id").agg(F.array_join(text, "").alias("html"))
