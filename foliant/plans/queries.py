"""The registered queries of the engine, over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant import api
from foliant import config as C
from foliant.functions import text as T
from foliant.operators import checks, chunking, html, layout, links, paragraphs, quality, regions, status
from foliant.shared import cut, shared_dir
from foliant.sources.tables import conversation_pairs, document_blocks, document_lines, pages_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Sql(str):
    """SQL with {0} for an expression; other braces are as they are, or doubled."""

    def format(self, x: str) -> Sql:
        return Sql(self.replace("{0}", x).replace("{{", "{").replace("}}", "}"))


# Views that the SQL side shares.
U = r"u AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS idx, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
B = U + r""", b AS (SELECT doc_id, idx, CASE WHEN idx % 9 = 3 THEN '## ' || t WHEN idx % 9 = 5 THEN '> ' || t WHEN idx % 13 = 7 THEN '![](images/a.png)'
 WHEN idx % 11 = 6 THEN 'a = b + (3)' WHEN idx % 7 = 2 THEN lower(left(t, 1)) || substr(t, 2) ELSE t END AS t FROM u)"""
P = "p AS (SELECT a.conv_id AS doc_id, a.turn AS id, a.text AS s, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"
L = U + r""", l AS (SELECT *, x0 + least(215.0, 0.5 * size * length(text)) AS x1, y0 + size AS y1, 530.0 AS width, 800.0 AS height FROM (
  SELECT doc_id, (idx // 40)::INT AS pno, idx AS line_no, 48.0::DOUBLE + 237 * (idx % 2) + CASE WHEN idx % 5 = 0 THEN 8 ELSE 0 END AS x0,
   80.0::DOUBLE + 17 * ((idx % 40) // 2) AS y0, trim(t) AS text, (CASE WHEN idx % 11 = 3 THEN 6.5 WHEN idx % 11 = 7 THEN 10.5 ELSE 8 END)::DOUBLE AS size,
   (CASE WHEN idx % 17 = 0 THEN 0.8 ELSE 0 END)::DOUBLE AS math FROM u))"""
W = r"[^\p{L}\p{N}_]"
KEY = Sql(rf"left(lower(regexp_replace({{0}}, '{W}+', '', 'g')), 40)")
COLLAPSE = Sql(r"trim(regexp_replace({0}, '\s+', ' ', 'g'))")
NORM = Sql(rf"trim(regexp_replace(regexp_replace(lower({COLLAPSE}), '^\d+\s+|\s+\d+$', '', 'g'), '\d+', '#', 'g'))")
NORM_LEN = Sql(r"length(regexp_replace({0}, '[\s\x{{AD}}-]', '', 'g'))::BIGINT")
IS_BODY = Sql(r"NOT regexp_matches({0}, '^\s*[#>!|]')")
ENDS = Sql(r"regexp_matches(rtrim(regexp_replace(rtrim({0}), '([.!?])\s?\d{{1,3}}$', '\1'), '_*^~`'), '[.!?:;\"'')\]”’」』]$')")
SENT_END = Sql(r"regexp_matches(rtrim({0}), '[.!?\"'')\]”’]$')")
LOOKS = Sql(r"(length(regexp_replace({0}, '\s', '', 'g')) > 0 AND length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) >= 0.7 * length(regexp_replace({0}, '\s', '', 'g')) AND regexp_matches({0}, '\p{{L}}{{3,}}|[가-힣ㄱ-ㆎ一-鿿]{{2,}}'))")
CONT = Sql(r"regexp_matches(ltrim({0}), '^([a-z]|−→|→|⇒|≈|≡|∑|≤|≥|[“‘\"'']\s*[a-z])')")
MATH = Sql(r"(length({0}) BETWEEN 1 AND 130 AND NOT regexp_matches({0}, '^[>!|]') AND regexp_matches({0}, '[=≈≤≥∑∏∫→←⇒∂±×÷∼≡∥]') AND len(regexp_extract_all({0}, '[A-Za-z]{{4,}}')) <= 3)")
BARE = Sql(r"regexp_replace(trim({0}), '^#{{1,6}}\s*', '')")
NUMBERS = Sql(r"list_distinct(list_filter(regexp_extract_all({0}, '[0-9.]+'), lambda x: regexp_full_match(x, '\d{{4}}|\d+\.\d+')))")
INTEGERS = Sql(r"list_distinct(list_filter(regexp_extract_all({0}, '[0-9.]+'), lambda x: regexp_full_match(x, '\d+')))")
UNITS = Sql(r"list_filter(list_transform(string_split({0}, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def lines_of(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.explode_lines(docs(spark, sf).select("doc_id", "text"))


def blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    return document_blocks(docs(spark, sf).select("doc_id", "text"))


def scalar(name: str, of: Callable[[Column], Column], sql: str, view: str = "u", cast: str | None = None) -> None:
    """A function on every line (view u) or block (b)."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = lines_of(spark, sf) if view == "u" else blocks_of(spark, sf)
        value = of(F.col("text"))
        return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), (value.cast(cast) if cast else value).alias("value"))

    query(name, f"WITH {U if view == 'u' else B} SELECT doc_id, idx, {Sql(sql).format('t')} AS value FROM {view}")(run)


scalar("fn_key", T.key, KEY)
scalar("fn_norm_flat", T.norm_flat, rf"lower(regexp_replace({{0}}, '{W}+', '', 'g'))")
scalar("fn_norm_len", T.norm_len, NORM_LEN)
scalar("fn_repeat_norm", T.repeat_norm, NORM)
scalar("fn_stitch_norm", T.stitch_norm, r"trim(regexp_replace(regexp_replace({0}, '\d+', '', 'g'), '\s+', ' ', 'g'))")
scalar("fn_sanitize", T.sanitize, r"regexp_replace(trim({0}), '\s+', '_', 'g')")
scalar("fn_looks_like_text", T.looks_like_text, LOOKS)
scalar("fn_is_body", T.is_body, IS_BODY, "b")
scalar("fn_is_continuation", T.is_continuation, CONT, "b")
scalar("fn_is_math_block", T.is_math_block, MATH.format(BARE), "b")
scalar("fn_is_caption", T.is_caption_text, r"regexp_matches(trim({0}), '(?i)^(figure|table|그림|표)\s*\d+\s*[.:)]')")
scalar("fn_is_table_row", T.is_table_row, r"(len(regexp_extract_all({0}, '\*')) >= 2 OR contains({0}, '|') OR len(list_filter(regexp_split_to_array(trim({0}), '\s+'), lambda x: regexp_matches(x, '^[\d.,%$/\[\]()·~-]+$'))) >= 3)", "b")
scalar("fn_ends_properly", T.ends_properly, ENDS)
scalar("fn_hangul_ratio", T.hangul_ratio, r"(CASE WHEN len(regexp_extract_all({0}, '[A-Za-z가-힣]')) > 0 THEN len(regexp_extract_all({0}, '[가-힣]')) / len(regexp_extract_all({0}, '[A-Za-z가-힣]')) ELSE 1.0 END)::DOUBLE", cast="double")
scalar("fn_image_links", lambda c: F.array_join(T.image_links(c), ","), r"array_to_string(regexp_extract_all({0}, '!\[[^\]]*\]\(([^)]+)\)', 1), ',')", "b")
scalar("fn_first_heading", T.first_heading, r"CASE WHEN regexp_matches({0}, '^#{{1,3}}\s+\S') THEN trim({0}) ELSE '' END", "b")
scalar("fn_is_bare_number", T.is_bare_number, r"regexp_full_match({0}, '_?\d{{1,4}}_?')")
scalar("fn_log_tail", lambda c: T.log_tail(c, 80), r"right({0}, 80)")
scalar("fn_math_ratio", lambda c: T.math_ratio(F.array(F.struct(c.alias("text"), F.lit("Roman").alias("font")), F.struct(F.left(c, F.lit(5)).alias("text"), F.lit("CMMI10").alias("font")))), r"(CASE WHEN length({0}) = 0 THEN 0.0 ELSE length(left({0}, 5)) / (length({0}) + length(left({0}, 5))) END)::DOUBLE", cast="double")
scalar("fn_is_substantial", regions.is_substantial, r"(length(regexp_replace({0}, '\s', '', 'g')) >= 6 AND (regexp_matches({0}, '[=≈≤≥∑∏∫→←⇒∂±×÷∼≡]') OR regexp_matches({0}, '\(\d{{1,2}}\)\s*$')))", "b")


@query("fn_join_unit", rf"WITH {U}, n AS (SELECT doc_id, idx, t, lead(t) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM u) SELECT doc_id, idx, CASE WHEN t = '' THEN p WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]-$') THEN left(t, length(t) - 1) || p ELSE t || ' ' || p END AS value FROM n WHERE p IS NOT NULL")
def fn_join_unit(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines_of(spark, sf).withColumn("p", F.lead("text").over(paragraphs.in_order())).where(F.col("p").isNotNull())
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), T.join_unit(F.col("text"), F.col("p")).alias("value"))


@query("fn_is_figure_xref", rf"WITH {U}, n AS (SELECT doc_id, idx, t, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY idx), '') AS p FROM u) SELECT doc_id, idx, regexp_matches(trim('Table 2) ' || t), '(?i)^(figure|table|그림|표)\s*\d+\s*\)') AND len(regexp_extract_all(p, '\(')) > len(regexp_extract_all(p, '\)')) AS value FROM n")
def fn_is_figure_xref(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines_of(spark, sf).withColumn("p", F.lag("text").over(paragraphs.in_order()))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), T.is_figure_xref(F.concat(F.lit("Table 2) "), F.col("text")), F.col("p")).alias("value"))


@query("fn_work_stem", r"SELECT page_id, trim(regexp_replace(url, '[^\p{L}\p{N}_,.-]+', '_', 'g'), '_') AS stem, regexp_full_match(url, '[^\\/:*?""<>|]+') AS safe FROM pages".replace('""', '"'))
def fn_work_stem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.work_stem(F.col("url")).alias("stem"), T.safe_stem(F.col("url")).alias("safe"))


@query("fn_clean", r"WITH m AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10) || chr(10)) AS t FROM documents) SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), ' ' || chr(10) || chr(9)) || chr(10)) AS value FROM m")
def fn_clean(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(T.clean(F.replace("text", F.lit("\n"), F.lit("\n\n\n")))).alias("value"))


@query("units_explode", rf"SELECT doc_id, unnest(range(len(l)))::BIGINT AS idx, unnest(l) AS text FROM (SELECT doc_id, {UNITS.format('replace(text, chr(10), chr(10) || chr(10))')} AS l FROM documents)")
def units_explode(spark: SparkSession, sf: str) -> DataFrame:
    rows = paragraphs.explode_units(docs(spark, sf).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))
    return rows.withColumn("idx", F.col("idx").cast("long"))


CHECKED = rf"""c AS (SELECT doc_id, idx, t FROM (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM b)
 WHERE length(t) > 80 AND {IS_BODY.format('t')} AND NOT regexp_matches(t, '(?i)^(figure|table|fig\.|source:|author\(s\):|published by:|stable url:|key:|그림|표\s)')
 AND NOT regexp_matches(t, '[A-Z]{{1,4}}\s?\d{{1,3}}\s+\d{{1,2}}/\d{{2,4}}\b') AND NOT regexp_matches(t, '^[""\s]*\*\s') AND NOT coalesce(regexp_matches(n, '^[>!]'), false))""".replace('""', '"')


@query("checked_paragraphs", f"WITH {B}, {CHECKED} SELECT doc_id, idx FROM c")
def checked_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return quality.checked_paragraphs(blocks_of(spark, sf)).select("doc_id", F.col("idx").cast("long").alias("idx"))


@query("truncated_ratio", f"WITH {B}, {CHECKED} SELECT doc_id, count(*) AS checked, count(*) FILTER (NOT {ENDS.format('t')}) AS bad FROM c GROUP BY doc_id")
def truncated_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return quality.truncated(blocks_of(spark, sf))


@query("truncated_by_language", rf"""WITH {U}, j AS (SELECT d.lang, u.* FROM u JOIN documents d ON d.doc_id = u.doc_id)
SELECT lang, count(*) AS n, sum({NORM_LEN.format('t')})::BIGINT AS chars, count(*) FILTER (length(t) > 80) AS checked, count(*) FILTER (length(t) > 80 AND NOT {ENDS.format('t')}) AS bad FROM j GROUP BY lang""")
def truncated_by_language(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("lang", F.explode(F.split("text", "\n")).alias("t"))
    t = F.col("t")
    long = F.length(t) > 80
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(T.norm_len(t)).alias("chars"), F.count_if(long).alias("checked"), F.count_if(long & ~T.ends_properly(t)).alias("bad"))


SCORES = f"""k AS (SELECT doc_id, sum({NORM_LEN.format('t')}) FILTER (idx % 10 <> 9) AS kept, sum({NORM_LEN.format('t')}) AS raw FROM b GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS checked, count(*) FILTER (NOT {ENDS.format('t')}) AS bad FROM c GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN raw > 0 THEN kept / raw ELSE 0.0 END::DOUBLE AS coverage, coalesce(bad / checked, 0.0)::DOUBLE AS truncated FROM k LEFT JOIN e USING (doc_id))"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    blocks = blocks_of(spark, sf)
    n = T.norm_len(F.col("text"))
    sizes = blocks.groupBy("doc_id").agg(F.sum(F.when(F.col("idx") % 10 != 9, n)).alias("kept"), F.sum(n).alias("raw"), F.lit(0).alias("dropped"))
    return quality.score(sizes, quality.truncated(blocks))


@query("score_gate", f"WITH {B}, {CHECKED}, {SCORES} SELECT doc_id, round(coverage, 6) AS coverage, round(truncated, 6) AS truncated, coverage >= 0.97 AND truncated <= 0.05 AS gate_ok FROM s")
def score_gate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gate(_scores(spark, sf)).select("doc_id", F.round("coverage", 6).alias("coverage"), F.round("truncated", 6).alias("truncated"), "gate_ok")


@query("bad_paragraph_topk", f"WITH {B}, {CHECKED} SELECT doc_id, n, head FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n, left(t, 100) AS head FROM c WHERE NOT {ENDS.format('t')}) WHERE n <= 20")
def bad_paragraph_topk(spark: SparkSession, sf: str) -> DataFrame:
    return quality.bad_paragraphs(blocks_of(spark, sf))


@query("extract_report", f"""WITH {B}, {CHECKED}, {SCORES}, bp AS (SELECT doc_id, string_agg('- ' || left(t, 100), chr(10) ORDER BY idx) AS l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM c WHERE NOT {ENDS.format('t')}) WHERE n <= 20 GROUP BY doc_id)
SELECT doc_id, '# Extraction report' || chr(10) || chr(10) || printf('coverage %.3f, truncated %.3f', coverage, truncated) || chr(10) || chr(10) || coalesce(l, '') AS report FROM s LEFT JOIN bp USING (doc_id) WHERE NOT (coverage >= 0.97 AND truncated <= 0.05)""")
def extract_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report(_scores(spark, sf), quality.bad_paragraphs(blocks_of(spark, sf)))


REPEATED = f"rep AS (SELECT norm, count(DISTINCT doc_id) AS pages, sum({NORM_LEN.format('t')})::BIGINT AS chars FROM (SELECT *, {NORM.format('t')} AS norm FROM u WHERE length(t) BETWEEN 1 AND 120) GROUP BY norm HAVING count(DISTINCT doc_id) >= 3)"


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.repeated_norms(lines_of(spark, sf), page="doc_id", by=None)


@query("repeated_norms", f"WITH {U}, {REPEATED} SELECT * FROM rep")
def repeated_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _repeated(spark, sf)


@query("repeated_chars", f"WITH {U}, {REPEATED} SELECT count(*) AS norms, coalesce(sum(chars), 0)::BIGINT AS chars FROM rep")
def repeated_chars(spark: SparkSession, sf: str) -> DataFrame:
    return _repeated(spark, sf).agg(F.count("*").alias("norms"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


@query("line_filter_anti", f"WITH {U}, {REPEATED} SELECT doc_id, idx FROM u WHERE {NORM.format('t')} NOT IN (SELECT norm FROM rep)")
def line_filter_anti(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.without_repeated(lines_of(spark, sf), _repeated(spark, sf), []).select("doc_id", F.col("idx").cast("long").alias("idx"))


HEADS = rf"""h AS (SELECT doc_id, idx, t, {NORM.format("array_to_string(w[1:3], ' ')")} AS head, w FROM (SELECT *, regexp_split_to_array(trim({BARE.format('t')}), '\s+') AS w FROM b)),
heads AS (SELECT DISTINCT doc_id, head FROM h WHERE idx % 4 = 1 AND len(w) >= 3),
st AS (SELECT h.doc_id, idx, t, w, (SELECT max(n) FROM (SELECT unnest(range(1, least(20, len(w)) + 1)) AS n) WHERE {NORM.format("array_to_string(w[1:n], ' ')")} IN (SELECT head FROM heads WHERE heads.doc_id = h.doc_id)) AS n FROM h)"""


@query("strip_running_heads", f"WITH {B}, {HEADS} SELECT doc_id, idx, CASE WHEN n IS NULL THEN t ELSE array_to_string(w[n + 1:], ' ') END AS text FROM st WHERE n IS NULL OR n < len(w)")
def strip_running_heads(spark: SparkSession, sf: str) -> DataFrame:
    blocks = blocks_of(spark, sf).repartition("doc_id")  # by which heads are gathered and joined
    words = F.split(T.collapse(T.without_head(F.col("text"))), " ")
    heads = blocks.where((F.col("idx") % 4 == 1) & (F.size(words) >= 3)).groupBy("doc_id").agg(F.collect_set(T.repeat_norm(F.array_join(F.slice(words, 1, 3), " "))).alias("norms"))
    return paragraphs.strip_running_heads(blocks, heads).withColumn("idx", F.col("idx").cast("long"))


@query("drop_cover", f"WITH {B}, v AS (SELECT doc_id, idx, CASE WHEN idx % 8 = 1 THEN 'JSTOR: ' || t ELSE t END AS t FROM b) SELECT doc_id, idx FROM v WHERE NOT (idx < 60 AND regexp_matches(t, '(?i)jstor|accessibility support|terms and conditions|about\\.jstor\\.org|is collaborating with|not-for-profit|remediated|all use subject to'))")
def drop_cover(spark: SparkSession, sf: str) -> DataFrame:
    blocks = blocks_of(spark, sf).withColumn("text", F.when(F.col("idx") % 8 == 1, F.concat(F.lit("JSTOR: "), F.col("text"))).otherwise(F.col("text")))
    return paragraphs.drop_cover(blocks).select("doc_id", F.col("idx").cast("long").alias("idx"))


@query("drop_math_blocks", f"WITH {B} SELECT doc_id, idx FROM b WHERE NOT {MATH.format(BARE.format('t'))}")
def drop_math_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.drop_math(blocks_of(spark, sf)).select("doc_id", F.col("idx").cast("long").alias("idx"))


@query("dropped_chars", f"WITH {B} SELECT doc_id, sum({NORM_LEN.format('t')})::BIGINT AS dropped FROM b WHERE {MATH.format(BARE.format('t'))} GROUP BY doc_id")
def dropped_chars(spark: SparkSession, sf: str) -> DataFrame:
    blocks = blocks_of(spark, sf)
    return paragraphs.dropped_chars(blocks, paragraphs.drop_math(blocks))


@query("drop_image_blocks", rf"WITH {B} SELECT doc_id, idx FROM b WHERE NOT regexp_full_match(trim(t), '!\[[^\]]*\]\([^)]*\)')")
def drop_image_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.drop_images(blocks_of(spark, sf)).select("doc_id", F.col("idx").cast("long").alias("idx"))


@query("mark_footnotes", rf"""WITH {L}, m AS (SELECT doc_id, line_no AS idx, CASE WHEN line_no % 3 = 0 THEN line_no || '. ' || text ELSE text END AS t, size, line_no % 19 = 4 AS note FROM l)
SELECT doc_id, idx, CASE WHEN (note OR size <= 8.0 * 0.85) AND NOT regexp_matches(trim(t), '(?i)^(figure|table|그림|표)\s*\d+\s*[.:)]') THEN
 CASE WHEN regexp_matches(t, '^\d') THEN '> **각주 ' || regexp_extract(t, '^(\d+)', 1) || '** ' || regexp_replace(t, '^\d+\s*\.?\s*', '') ELSE '> **각주** ' || t END ELSE t END AS text FROM m""")
def mark_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(docs(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("idx"), F.when(F.col("line_no") % 3 == 0, F.concat(F.col("line_no").cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text")).alias("text"), "size", (F.col("line_no") % 19 == 4).alias("note"), F.lit(8.0).alias("body_size"))
    return paragraphs.mark_footnotes(lines).select("doc_id", "idx", "text")


@query("mark_headings", f"WITH {B} SELECT doc_id, idx, CASE WHEN idx % 6 = 2 AND NOT starts_with(t, '#') THEN '## ' || t ELSE t END AS text FROM b")
def mark_headings(spark: SparkSession, sf: str) -> DataFrame:
    blocks = blocks_of(spark, sf).withColumn("heading", F.col("idx") % 6 == 2)
    return paragraphs.mark_headings(blocks).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


MERGE = rf"""f AS (SELECT *, {IS_BODY.format('t')} AS body, sum(regexp_matches(t, '^\s*#')::INT) OVER w AS heads FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
g AS (SELECT *, last_value(CASE WHEN body THEN NOT {SENT_END.format('t')} END IGNORE NULLS) OVER q AS open, last_value(CASE WHEN body THEN heads END IGNORE NULLS) OVER q AS ph
 FROM f WINDOW q AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum((body AND NOT (coalesce(open, false) AND coalesce(ph = heads, false) AND {CONT.format('t')}))::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM g),
n AS (SELECT *, lead(idx) OVER (PARTITION BY doc_id, island ORDER BY idx) AS nx FROM i WHERE body),
m AS (SELECT doc_id, island, 0 AS rank, min(idx) AS idx, string_agg(CASE WHEN nx IS NULL THEN t WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]-$') THEN left(t, length(t) - 1) ELSE t || ' ' END, '' ORDER BY idx) AS t FROM n GROUP BY doc_id, island
 UNION ALL SELECT doc_id, island, 1, idx, t FROM i WHERE NOT body)"""


@query("merge_continuations", f"WITH {B}, {MERGE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island, rank, idx) - 1 AS idx, t AS text FROM m")
def merge_continuations(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.merge_continuations(blocks_of(spark, sf)).withColumn("idx", F.col("idx").cast("long"))


SECTIONS = "x AS (SELECT *, sum(regexp_matches(t, '^#{1,3}\\s+\\S')::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS h FROM b), y AS (SELECT doc_id, (h - CASE WHEN min(h) OVER (PARTITION BY doc_id) = 1 THEN 1 ELSE 0 END)::BIGINT AS sec, idx, t, max(idx) OVER (PARTITION BY doc_id) AS mx FROM x), z AS (SELECT doc_id, sec AS idx, string_agg(t || CASE WHEN idx < mx THEN chr(10) ELSE '' END, '' ORDER BY idx) AS text FROM y GROUP BY doc_id, sec)"


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    whole = paragraphs.assemble_text(blocks_of(spark, sf), "\n")
    return chunking.split_sections(whole)


@query("split_sections", f"WITH {B}, {SECTIONS} SELECT doc_id, idx, md5(text) AS text FROM z WHERE text <> ''")
def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(spark, sf).select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("text"))


def _parts(of: str, most: int, name: str) -> str:
    """CTEs: the parts (part, text) of the texts of view of (doc_id, idx, text), as hard_split makes them."""
    fits = f"(r.t = '' OR length(r.t) + length(p.t) + 2 <= {most})"
    return f"""{name}_p AS (SELECT doc_id, idx, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM (SELECT doc_id, idx, string_split(text, chr(10) || chr(10)) AS l FROM {of})),
{name}_r AS (SELECT doc_id, idx, i, t, 1 AS part FROM {name}_p WHERE i = 1 UNION ALL
 SELECT p.doc_id, p.idx, p.i, CASE WHEN r.t = '' OR NOT {fits} THEN p.t ELSE r.t || chr(10) || chr(10) || p.t END, r.part + CASE WHEN {fits} THEN 0 ELSE 1 END FROM {name}_r r JOIN {name}_p p ON p.doc_id = r.doc_id AND p.idx = r.idx AND p.i = r.i + 1),
{name} AS (SELECT * FROM (SELECT doc_id, idx, part, arg_max(t, i) AS text FROM {name}_r GROUP BY doc_id, idx, part) WHERE text <> '')"""


@query("hard_split", f"WITH RECURSIVE d AS (SELECT doc_id, 0 AS idx, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), {_parts('d', 1000, 'hs')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS k, length(text)::BIGINT AS chars FROM hs")
def hard_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = docs(spark, sf).select("doc_id", F.posexplode(chunking.hard_split(F.replace("text", F.lit("\n"), F.lit("\n\n")), 1000)).alias("k", "part"))
    return parts.select("doc_id", F.col("k").cast("long").alias("k"), F.length("part").cast("long").alias("chars"))


# A document in seven has blank lines, so that long sections can be split.
SPACED = f"""{B.replace("ELSE t END AS t FROM u", "ELSE CASE WHEN doc_id % 7 = 3 THEN t || chr(10) ELSE t END END AS t FROM u")}, {SECTIONS}, lg AS (SELECT * FROM z WHERE length(text) > 6000), {_parts('lg', 6000, 'hs')},
a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, part) AS k, text, length(text) AS n, sealed FROM (SELECT doc_id, idx, 0 AS part, text, false AS sealed FROM z WHERE length(text) BETWEEN 1 AND 6000 UNION ALL SELECT doc_id, idx, part, text, true FROM hs)),
r AS (SELECT doc_id, k, n AS total, sealed, 1 AS chunk FROM a WHERE k = 1 UNION ALL SELECT a.doc_id, a.k, CASE WHEN a.sealed OR r.sealed OR r.total + a.n > 6000 THEN a.n ELSE r.total + a.n END, a.sealed, r.chunk + CASE WHEN a.sealed OR r.sealed OR r.total + a.n > 6000 THEN 1 ELSE 0 END FROM r JOIN a ON a.doc_id = r.doc_id AND a.k = r.k + 1),
c AS (SELECT doc_id, lpad(chunk::VARCHAR, 3, '0') || '.md' AS id, string_agg(text, '' ORDER BY k) AS text FROM r JOIN a USING (doc_id, k) GROUP BY doc_id, chunk)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.when((F.col("doc_id") % 7 == 3) & ~F.col("marked"), F.concat(F.col("text"), F.lit("\n"))).otherwise(F.col("text"))
    i = F.col("idx")
    blocks = blocks_of(spark, sf).withColumn("marked", (i % 9 == 3) | (i % 9 == 5) | (i % 13 == 7) | (i % 11 == 6) | (i % 7 == 2)).withColumn("text", blank)
    return chunking.chunks(chunking.split_sections(paragraphs.assemble_text(blocks, "\n")))


@query("greedy_chunks", f"WITH RECURSIVE {SPACED} SELECT doc_id, id, length(text)::BIGINT AS chars, md5(text) AS text FROM c")
def greedy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("doc_id", "id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text"))


@query("chunk_index", rf"""WITH RECURSIVE {SPACED}, e AS (SELECT doc_id, id, {{'id': id, 'chars': length(text), 'images': regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1), 'heading': coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{{1,3}}\s+\S'))[1]), '')}} AS e FROM c)
SELECT doc_id, to_json(list(e ORDER BY id))::VARCHAR AS json FROM e GROUP BY doc_id""")
def chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.index_json(chunking.chunk_index(_chunks(spark, sf)))


# Layout --------------------------------------------------------------------------------------------------------------


def _layout(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = document_lines(docs(spark, sf).select("doc_id", "text"))
    return lines, pages_of(lines)


BODY = "body AS (SELECT doc_id, median(size) AS b FROM l WHERE size > 0 GROUP BY doc_id)"
BAND = BODY + """, share AS (SELECT doc_id, b, round_even(size, 1) AS s, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS q FROM l JOIN body USING (doc_id) WHERE size > 0 GROUP BY doc_id, b, round_even(size, 1)),
band AS (SELECT doc_id, b, least(b * 0.90, min(CASE WHEN q >= 0.2 AND s < b AND s >= b * 0.8 THEN s - 0.05 END)) AS lo, greatest(b * 1.12, max(CASE WHEN q >= 0.2 AND s > b AND s <= b * 1.2 THEN s + 0.05 END)) AS hi FROM share GROUP BY doc_id, b)"""
READ = BAND + rf""", rp AS (SELECT doc_id, {NORM.format('text')} AS norm FROM l WHERE length(text) BETWEEN 1 AND 120 GROUP BY ALL HAVING count(DISTINCT pno) >= 3),
k1 AS (SELECT l.*, b, lo, hi FROM l JOIN band USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.doc_id = l.doc_id AND rp.norm = {NORM.format('l.text')})
 AND NOT (regexp_matches(text, '^[\[\(]?\d{{1,4}}[\]\)]?$') AND NOT (y0 > 800 * 0.08 AND y0 < 800 * 0.92)) AND NOT (size > 0 AND length(text) < 80 AND size >= b * 1.08 AND NOT {LOOKS.format('text')})),
k2 AS (SELECT *, CASE WHEN x1 - x0 > 318 THEN 0 WHEN (x0 + x1) / 2 < 265 THEN 1 ELSE 2 END AS side FROM k1),
k3 AS (SELECT *, CASE WHEN bool_or(side = 1) OVER g AND bool_or(side = 2) OVER g THEN side ELSE 0 END AS col_rank, coalesce(max(CASE WHEN size BETWEEN lo AND hi THEN y0 END) OVER g, 0) AS floor FROM k2 WINDOW g AS (PARTITION BY doc_id, pno)),
edges AS (SELECT doc_id, pno, col_rank, CASE WHEN count(*) >= 8 THEN first(rx ORDER BY c DESC, rx) ELSE min(x0) END AS edge, max(x1) AS "right" FROM (SELECT *, round_even(x0, 0) AS rx, count(*) OVER (PARTITION BY doc_id, pno, col_rank, round_even(x0, 0)) AS c FROM k3) GROUP BY doc_id, pno, col_rank),
k4 AS (SELECT k3.*, edge, "right", y0 > 320 AND NOT regexp_matches(trim(text), '(?i)^(figure|table|그림|표)\s*\d+\s*[.:)]') AND size > 0 AND (size <= b * 0.85 OR (size < lo AND y0 > floor)) AS is_note FROM k3 JOIN edges USING (doc_id, pno, col_rank) WHERE {KEY.format('text')} <> ''),
ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pno, is_note, col_rank, y0, line_no) - 1 AS seq FROM k4)"""


@query("body_size_band", f"WITH {L}, {BAND} SELECT doc_id, b AS body_size, round(lo, 6) AS lo, round(hi, 6) AS hi FROM band")
def body_size_band(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = _layout(spark, sf)
    return layout.body_band(lines, layout.body_sizes(lines)).select("doc_id", "body_size", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("column_edge", f"WITH {L}, {READ} SELECT DISTINCT doc_id, pno, col_rank, edge, round(\"right\", 6) AS \"right\" FROM k3 JOIN edges USING (doc_id, pno, col_rank)")
def column_edge(spark: SparkSession, sf: str) -> DataFrame:
    lines, pages = _layout(spark, sf)
    bodies = layout.body_sizes(lines)
    rows = paragraphs.without_repeated(lines, paragraphs.repeated_norms(lines), ["doc_id"]).join(pages, ["doc_id", "pno"]).join(bodies, "doc_id")
    rows = rows.where(~T.is_page_number(F.col("text"), F.col("y0"), F.col("height")) & ~T.is_scan_debris(F.col("text"), F.col("size"), F.col("body_size"))).drop("width", "height")
    return layout.column_edges(layout.placed(rows, pages)).withColumn("right", F.round("right", 6))


@query("reading_order", f"WITH {L}, {READ} SELECT doc_id, seq, line_no, is_note FROM ord")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    found = layout.ordered_lines(*_layout(spark, sf))
    return found.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("line_no").cast("long").alias("line_no"), "is_note")


FLAGS = READ + rf""", pv AS (SELECT *, lag(text) OVER o AS pt, lag(x0) OVER o AS px0, lag(x1) OVER o AS px1, lag(edge) OVER o AS pe, lag("right") OVER o AS pr, lag(size) OVER o AS ps, seq = 0 AS f FROM ord WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
bs AS (SELECT *, b > 0 AND length(text) < 80 AND ("right" - edge <= 0 OR x1 - x0 < ("right" - edge) * 0.7) AND {LOOKS.format('text')} AND size > hi AS base, coalesce({SENT_END.format('pt')}, false) AS pend FROM pv),
sd AS (SELECT *, base AND (size >= b * 1.25 OR (size >= b * 1.08 AND (f OR pend))) AS seed, base AND size >= b * 1.08 AS med FROM bs),
hd AS (SELECT *, seed OR (med AND coalesce(max(CASE WHEN seed THEN seq END) OVER c > coalesce(max(CASE WHEN NOT med THEN seq END) OVER c, -1), false)) AS is_heading FROM sd WINDOW c AS (PARTITION BY doc_id ORDER BY seq)),
fl AS (SELECT *, (regexp_matches(trim(text), '(?i)^(figure|table|그림|표)\s*\d+\s*[.:)]') AND NOT (regexp_matches(trim(text), '(?i)^(figure|table|그림|표)\s*\d+\s*\)') AND len(regexp_extract_all(coalesce(pt, ''), '\(')) > len(regexp_extract_all(coalesce(pt, ''), '\)'))))
 OR f OR (x0 - edge >= 6 AND NOT coalesce(px0 - pe >= 6 AND abs((px0 - pe) - (x0 - edge)) <= 3, false)) OR (pend AND coalesce(px1 < pr - 25, false)) OR is_heading OR coalesce(lag(is_heading) OVER (PARTITION BY doc_id ORDER BY seq), false)
 OR coalesce(ps > 0 AND size > 0 AND ((size <= b * 0.85 AND ps > b * 0.85) OR (size > b * 0.85 AND ps <= b * 0.85)), false) AS is_start FROM hd)"""


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return layout.line_flags(layout.ordered_lines(*_layout(spark, sf)), layout.READING)


@query("paragraph_starts", f"WITH {L}, {FLAGS} SELECT doc_id, seq, is_start, is_heading FROM fl")
def paragraph_starts(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf).select("doc_id", F.col("seq").cast("long").alias("seq"), "is_start", "is_heading")


@query("page_last", f"WITH {L}, {FLAGS} SELECT doc_id, pno, {KEY.format('arg_max(text, seq)')} AS last_key FROM fl WHERE is_start AND y0 > 64 AND y0 < 736 GROUP BY doc_id, pno")
def page_last(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_last(_flags(spark, sf))


@query("first_sizes", f"WITH {L}, {READ} SELECT doc_id, {KEY.format('text')} AS key, arg_min(size, seq) AS size, bool_or(is_note) AS note FROM ord GROUP BY ALL")
def first_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return layout.first_sizes(layout.ordered_lines(*_layout(spark, sf)))


@query("raw_markdown", f"WITH {L}, {READ} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS text FROM ord GROUP BY doc_id")
def raw_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return layout.raw_markdown(layout.ordered_lines(*_layout(spark, sf))).select("doc_id", F.md5("text").alias("text"))


HIT = "CASE WHEN ks[{0} + 1] = k THEN {0} + 1 WHEN ks[{0} + 2] = k THEN {0} + 2 WHEN ks[{0} + 3] = k THEN {0} + 3 END"
GLUE = Sql(r"string_agg(CASE WHEN {0} IS NULL THEN t WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]-$') THEN left(t, length(t) - 1) ELSE t || ' ' END, '' ORDER BY i)")


@query("rebuild_paragraphs", f"""WITH RECURSIVE {L}, {FLAGS}, sq AS (SELECT doc_id, list({KEY.format('text')} ORDER BY seq) AS ks, list(is_start ORDER BY seq) AS fs, list({KEY.format('text')}) FILTER (is_start) AS sk FROM fl GROUP BY doc_id),
un AS (SELECT doc_id, t, {KEY.format('t')} AS k, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i, regexp_matches(t, '^[#!|>]') AS m FROM u WHERE {KEY.format('t')} <> ''),
st AS (SELECT un.*, ks, fs, coalesce(list_contains(sk, k), false) AS s FROM un LEFT JOIN sq USING (doc_id)),
rc AS (SELECT doc_id, i, coalesce(h, 0) AS at, m OR coalesce(fs[h], s) AS b FROM (SELECT *, {Sql(HIT).format('0')} AS h FROM st WHERE i = 1)
 UNION ALL SELECT doc_id, i, coalesce(h, pat), m OR coalesce(fs[h], s) FROM (SELECT st.*, rc.at AS pat, {Sql(HIT).format('rc.at')} AS h FROM rc JOIN st ON st.doc_id = rc.doc_id AND st.i = rc.i + 1)),
nb AS (SELECT st.doc_id, st.i, t, k, (sum(b::INT) OVER w - first_value(b::INT) OVER w)::BIGINT AS para FROM st JOIN rc USING (doc_id, i) WINDOW w AS (PARTITION BY st.doc_id ORDER BY st.i)),
nx AS (SELECT *, lead(i) OVER (PARTITION BY doc_id, para ORDER BY i) AS nx FROM nb)
SELECT doc_id, para AS idx, arg_min(k, i) AS key0, md5({GLUE.format('nx')}) AS text FROM nx GROUP BY doc_id, para""")
def rebuild_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    flags = _flags(spark, sf).select("doc_id", F.col("seq").alias("idx"), T.key(F.col("text")).alias("key"), "is_start")
    units = lines_of(spark, sf).where(T.key(F.col("text")) != "")
    return paragraphs.rebuild_paragraphs(units, flags).select("doc_id", "idx", "key0", F.md5("text").alias("text"))


@query("stitch_pages", rf"""WITH RECURSIVE {U}, nm AS (SELECT *, CASE WHEN length(t) < 120 THEN trim(regexp_replace(regexp_replace(t, '\d+', '', 'g'), '\s+', ' ', 'g')) END AS norm FROM u),
kp AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i FROM (SELECT *, count(norm) OVER (PARTITION BY doc_id, norm) AS times FROM nm) WHERE NOT coalesce(times >= 3 AND norm <> '', false) AND NOT regexp_full_match(t, '_?\d{{1,4}}_?')),
fa AS (SELECT *, length(t) > 80 AND {IS_BODY.format('t')} AND NOT regexp_matches(rtrim(regexp_replace(t, '[_*^]+$', '')), '[.!?"'')\]“”‘’]$') AS o, regexp_matches(t, '^\s*#') AS h, regexp_matches(t, '^[a-z]') AS lo,
 NOT ({IS_BODY.format('t')}) OR length(t) < 80 OR regexp_matches(t, '(?i)^(figure|table|fig\.|source:)') OR regexp_matches(t, '^\^[\s\d]') AS pa FROM kp),
tg AS (SELECT *, first_value(CASE WHEN h OR NOT pa THEN i END IGNORE NULLS) OVER w AS tgt, first_value(CASE WHEN h OR NOT pa THEN NOT h AND lo END IGNORE NULLS) OVER w AS ok FROM fa WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
rc AS (SELECT doc_id, i, coalesce(o AND ok, false) AS take, CASE WHEN o AND ok THEN tgt ELSE 0 END AS till FROM tg WHERE i = 1
 UNION ALL SELECT t.doc_id, t.i, coalesce(t.i > rc.till AND o AND ok, false), CASE WHEN t.i > rc.till AND o AND ok THEN tgt ELSE rc.till END FROM rc JOIN tg t ON t.doc_id = rc.doc_id AND t.i = rc.i + 1),
pr AS (SELECT doc_id, tgt AS i, i AS into_i FROM tg JOIN rc USING (doc_id, i) WHERE take),
gl AS (SELECT kp.doc_id, kp.i, t, coalesce(into_i, kp.i) AS g FROM kp LEFT JOIN pr ON pr.doc_id = kp.doc_id AND pr.i = kp.i),
nx AS (SELECT *, lead(i) OVER (PARTITION BY doc_id, g ORDER BY i) AS nx FROM gl)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS idx, md5(t) AS text FROM (SELECT doc_id, g, {GLUE.format('nx')} AS t FROM nx GROUP BY doc_id, g)""")
def stitch_pages(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.stitch_pages(lines_of(spark, sf)).select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("text"))


@query("lines_of_spans", rf"""WITH {U} SELECT doc_id, idx AS line_no, trim(t || 'xy') AS text, 8.0::DOUBLE AS size, (2 / (length(t) + 2))::DOUBLE AS math FROM u""")
def lines_of_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = lines_of(spark, sf).select("doc_id", F.lit(0).alias("pno"), F.col("idx").cast("long").alias("line_no"), F.explode(F.array(F.struct(F.lit(0).alias("span_no"), F.col("text").alias("text"), F.lit("Roman").alias("font"), F.lit(8.0).alias("size")), F.struct(F.lit(1).alias("span_no"), F.lit("xy").alias("text"), F.lit("CMMI10").alias("font"), F.lit(8.0).alias("size")))).alias("s"))
    return layout.lines_of_spans(spans.select("doc_id", "pno", "line_no", "s.*")).select("doc_id", "line_no", "text", "size", "math")


@query("span_source", f"""WITH {L}, s AS (SELECT *, idx AS n FROM (SELECT *, line_no AS idx FROM l) WHERE pno = 1)
SELECT doc_id, count(*) AS spans, sum(length(text))::BIGINT AS chars, round(max(x1), 6) AS x1, md5(string_agg(text, chr(10) ORDER BY n)) AS text FROM s GROUP BY doc_id""")
def span_source(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as a dump; the second ones of all documents are read back, and nothing of other blocks' files."""
    import uuid

    from foliant.sources import spans

    at = f"{shared_dir(spark)}/spans-{uuid.uuid4().hex}"
    lines, pages = _layout(spark, sf)
    span = F.struct("x0", "y0", "x1", "y1", "size", F.lit("Roman").alias("font"), "text")
    held = lines.groupBy("doc_id", "pno").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", span.alias("s")))), lambda x: x["s"]).alias("spans"))
    spans.write_dump(held.join(pages, ["doc_id", "pno"]), at, block=16)
    found = spans.read_spans(spark, at, "doc_id long, pno int, span_no int, x1 double, text string", pno_from=1, pno_to=1)
    parts = F.sort_array(F.collect_list(F.struct("span_no", "text")))
    text = F.array_join(F.transform(parts, lambda x: x["text"]), "\n")
    return found.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.length("text")).cast("long").alias("chars"), F.round(F.max("x1"), 6).alias("x1"), F.md5(text).alias("text"))


# Regions -------------------------------------------------------------------------------------------------------------

# A box on each page, and every line as a target.
BOXES = "box AS (SELECT DISTINCT doc_id, pno, 40.0 AS rx0, 150.0 AS ry0, 270.0 AS rx1, 260.0 AS ry1 FROM l)"
COVERED = BOXES + ", cov AS (SELECT l.* FROM l JOIN box USING (doc_id, pno) WHERE (x0 + x1) / 2 BETWEEN rx0 AND rx1 AND y0 BETWEEN ry0 AND ry1)"
TARGETS = "tg AS (SELECT doc_id, pno, line_no, x0, x1, y0, y1, text, size FROM l)"
BOUNDS = TARGETS + """, bd AS (SELECT t.doc_id, t.pno, t.line_no, coalesce(min(CASE WHEN own THEN l0 END), min(l0)) AS "left", coalesce(max(CASE WHEN own THEN l1 END), max(l1)) AS "right" FROM (
 SELECT t.*, l.x0 AS l0, l.x1 AS l1, ((l.x0 + l.x1) / 2 < 265) = ((t.x0 + t.x1) / 2 < 265) AND t.x1 - t.x0 <= 318 AS own FROM tg t JOIN l USING (doc_id, pno)) t GROUP BY ALL)""".replace("GROUP BY ALL)", "GROUP BY t.doc_id, t.pno, t.line_no)")


def _boxes(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "pno").distinct().select("doc_id", "pno", F.lit(40.0).alias("x0"), F.lit(150.0).alias("y0"), F.lit(270.0).alias("x1"), F.lit(260.0).alias("y1"))


def _targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines, pages = _layout(spark, sf)
    t_id = F.struct("doc_id", F.col("line_no").cast("long").alias("line_no")).alias("t_id")
    targets = lines.join(pages, ["doc_id", "pno"]).select(t_id, "doc_id", "pno", "x0", "x1", "y0", "y1", "text", "size", "width", "height")
    return regions.column_bounds(targets, lines), lines


@query("covers_range_join", f"WITH {L}, {COVERED} SELECT doc_id, line_no FROM cov")
def covers_range_join(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = _layout(spark, sf)
    return regions.covered(lines, _boxes(lines)).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("outside_anti_range", f"WITH {L}, {COVERED} SELECT doc_id, line_no FROM l EXCEPT ALL SELECT doc_id, line_no FROM cov")
def outside_anti_range(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = _layout(spark, sf)
    return regions.outside(lines, _boxes(lines)).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


# Five regions from every line on, of all sizes: 200 on a full page.
MANY = "rg AS (SELECT doc_id, pno, line_no * 5 + k AS region, x0 - 7 * k AS rx0, y0 - 11 AS ry0, x0 + 1.0 * (line_no % 13 + 1) * (1 + 9 * k) AS rx1, y0 + 1.0 * (line_no % 7) * (1 + 5 * k) AS ry1 FROM l, range(5) r(k))"


@query("regions_of_lines", f"WITH {L}, {MANY} SELECT l.doc_id, line_no, count(*) AS regions, sum(region)::BIGINT AS region_sum FROM l JOIN rg USING (doc_id, pno) WHERE (x0 + x1) / 2 BETWEEN rx0 AND rx1 AND y0 BETWEEN ry0 AND ry1 GROUP BY ALL")
def regions_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = _layout(spark, sf)
    k, n = F.col("k"), F.col("line_no")
    many = lines.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(5)]))).select(
        "doc_id", "pno", (n * 5 + k).cast("long").alias("region"), (F.col("x0") - 7 * k).alias("x0"), (F.col("y0") - 11).alias("y0"), (F.col("x0") + 1.0 * (n % 13 + 1) * (1 + 9 * k)).alias("x1"), (F.col("y0") + 1.0 * (n % 7) * (1 + 5 * k)).alias("y1")
    )
    found = regions.covering(lines, many, keep=("region",))
    return found.groupBy("doc_id", F.col("line_no").cast("long").alias("line_no")).agg(F.count("*").alias("regions"), F.sum("region").alias("region_sum"))


@query("region_chars", f"WITH {L}, {COVERED} SELECT doc_id, sum({NORM_LEN.format('text')})::BIGINT AS chars FROM cov GROUP BY doc_id")
def region_chars(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = _layout(spark, sf)
    return regions.region_chars(lines, _boxes(lines))


@query("column_bounds", f'WITH {L}, {BOUNDS} SELECT doc_id, line_no, round("left", 6) AS "left", round("right", 6) AS "right" FROM bd')
def column_bounds(spark: SparkSession, sf: str) -> DataFrame:
    targets, _ = _targets(spark, sf)
    return targets.select("doc_id", "t_id.line_no", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query("anchor_asof", f"""WITH {L}, {BOUNDS} SELECT t.doc_id, t.line_no, coalesce(arg_max(l.text, l.y1 * 1000000 - l.line_no), '') AS anchor FROM tg t JOIN bd USING (doc_id, pno, line_no)
LEFT JOIN l ON l.doc_id = t.doc_id AND l.pno = t.pno AND l.y1 <= t.y0 + 1 AND (l.x0 + l.x1) / 2 BETWEEN "left" - 2 AND "right" + 2 GROUP BY t.doc_id, t.line_no""")
def anchor_asof(spark: SparkSession, sf: str) -> DataFrame:
    targets, lines = _targets(spark, sf)
    return regions.anchor_above(targets, lines).select("t_id.doc_id", "t_id.line_no", "anchor")


TABLE_ROW = r"(len(regexp_extract_all({0}, '\*')) >= 2 OR contains({0}, '|') OR len(list_filter(regexp_split_to_array(trim({0}), '\s+'), lambda x: regexp_matches(x, '^[\d.,%$/\[\]()·~-]+$'))) >= 3)"


# Two lines of three are made captions, and all stand closer than they do.
@query("caption_test", f"""WITH {L}, {BOUNDS}, {BODY}, v AS (SELECT *, y0 * 0.7 AS v0, CASE WHEN line_no % 3 = 0 THEN text ELSE 'Figure 1. ' || text END AS tx FROM l),
gap AS (SELECT t.doc_id, t.line_no, max(a.v0) AS a FROM v t LEFT JOIN v a ON a.doc_id = t.doc_id AND a.pno = t.pno AND a.x1 >= t.x0 - 30 AND a.x0 <= t.x1 + 30 AND a.v0 < t.v0 - 2 GROUP BY ALL)
SELECT v.doc_id, v.line_no FROM v JOIN bd USING (doc_id, pno, line_no) JOIN gap USING (doc_id, line_no) JOIN body USING (doc_id) WHERE regexp_matches(trim(tx), '(?i)^(figure|table|그림|표)\\s*\\d+\\s*[.:)]')
 AND (size <= b * 0.95 OR a IS NULL OR v0 - a >= 15 OR ("right" > "left" AND x0 - "left" >= ("right" - "left") * 0.15))""")
def caption_test(spark: SparkSession, sf: str) -> DataFrame:
    targets, lines = _targets(spark, sf)
    n, y0 = F.col("t_id.line_no"), F.col("y0") * 0.7
    made = targets.withColumn("text", F.when(n % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Figure 1. "), F.col("text")))).withColumn("y1", y0 + F.col("size")).withColumn("y0", y0)
    return regions.captions(made.join(layout.body_sizes(lines), "doc_id")).select("t_id.doc_id", "t_id.line_no")


def _scan(above: bool) -> str:
    near = "l.y0 < t.y0 - 2 AND l.y0 >= greatest(t.y0 - 480, 0)" if above else "l.y0 > t.y1 + 1 AND l.y0 <= least(t.y1 + 680, 800)"
    order = "l.y0 DESC, l.line_no" if above else "l.y0, l.line_no"
    value, start = ("y0 - 2", "ty0") if above else ("y1", "ty1")
    return f"""WITH {L}, {BOUNDS}, {BAND}, wk AS (SELECT t.doc_id, t.line_no, l.y0, l.y1, row_number() OVER (PARTITION BY t.doc_id, t.line_no ORDER BY {order}) AS n,
 (l.size BETWEEN lo AND hi AND l.x1 - l.x0 >= greatest("right" - "left", 1) * 0.4 AND NOT {Sql(TABLE_ROW).format('l.text')})::INT AS prose FROM tg t JOIN bd USING (doc_id, pno, line_no) JOIN band USING (doc_id) JOIN l ON l.doc_id = t.doc_id AND l.pno = t.pno AND {near} AND l.x1 >= t.x0 - 30 AND l.x0 <= t.x1 + 30),
rn AS (SELECT *, sum(prose) OVER (PARTITION BY doc_id, line_no ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM wk),
sp AS (SELECT *, min(CASE WHEN run = 3 THEN n END) OVER (PARTITION BY doc_id, line_no) AS stop FROM rn),
fr AS (SELECT doc_id, line_no, arg_max({value}, n) AS far FROM sp WHERE prose = 0 AND (stop IS NULL OR n < stop) GROUP BY doc_id, line_no)
SELECT doc_id, line_no, coalesce(far, {start}) AS edge FROM (SELECT doc_id, line_no, y0 AS ty0, y1 AS ty1 FROM tg) LEFT JOIN fr USING (doc_id, line_no)"""


def _edges(above: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        targets, lines = _targets(spark, sf)
        band = layout.body_band(lines, layout.body_sizes(lines))
        return regions.region_edge(targets.join(band, "doc_id"), lines, above).select("t_id.doc_id", "t_id.line_no", "edge")

    return run


query("region_scan_top", _scan(True))(_edges(True))
query("region_scan_bottom", _scan(False))(_edges(False))


# Lines at a quarter of their places and widths, so that columns come near; a seed on every line.
@query("label_growth", f"""WITH {L}, {TARGETS}, {BAND}, q AS (SELECT *, x0 / 4 AS a, x0 / 4 + (x1 - x0) / 4 AS b4 FROM l),
lb AS (SELECT t.doc_id, t.line_no, q.a AS x0, q.b4 AS x1, 0 AS seed FROM tg t JOIN band USING (doc_id) JOIN q ON q.doc_id = t.doc_id AND q.pno = t.pno AND q.y0 BETWEEN t.y0 - 20 AND t.y0 + 20
 WHERE NOT (q.size BETWEEN lo AND hi AND q.b4 - q.a >= 30 * 0.4 AND NOT {Sql(TABLE_ROW).format('q.text')}) UNION ALL SELECT doc_id, line_no, x0, x0 + 30, 1 FROM tg),
rc AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, line_no ORDER BY x0, x1, seed DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM lb),
il AS (SELECT *, sum(coalesce((x0 - reach > 40)::INT, 0)) OVER (PARTITION BY doc_id, line_no ORDER BY x0, x1, seed DESC ROWS UNBOUNDED PRECEDING) AS i FROM rc WHERE n > 1)
SELECT doc_id, line_no, min(x0) AS x0, round(max(x1), 6) AS x1 FROM il GROUP BY doc_id, line_no, i HAVING max(seed) = 1""")
def label_growth(spark: SparkSession, sf: str) -> DataFrame:
    targets, lines = _targets(spark, sf)
    band = layout.body_band(lines, layout.body_sizes(lines))
    seeds = targets.join(band, "doc_id").select("t_id", "doc_id", "pno", "x0", (F.col("x0") + 30).alias("x1"), (F.col("y0") - 20).alias("y0"), (F.col("y0") + 20).alias("y1"), "lo", "hi")
    labels = lines.select("doc_id", "pno", (F.col("x0") / 4).alias("x0"), (F.col("x0") / 4 + (F.col("x1") - F.col("x0")) / 4).alias("x1"), "y0", "size", "text")
    return regions.label_growth(seeds, labels).select("t_id.doc_id", "t_id.line_no", "x0", F.round("x1", 6).alias("x1"))


# The lower half of a page stands further down, and two lines of three have an operator.
@query("equation_islands", f"""WITH {L}, m AS (SELECT doc_id, pno, line_no, x0, x1, y0 + k AS y0, y1 + k AS y1, CASE WHEN line_no % 3 = 1 THEN text ELSE text || ' = x' END AS tx FROM (SELECT *, CASE WHEN line_no % 40 >= 20 THEN 30 ELSE 0 END AS k FROM l)),
q AS (SELECT *, y0 - lag(y1) OVER o AS gap, lag(y1) OVER o - lag(y0) OVER o AS ph FROM m WINDOW o AS (PARTITION BY doc_id, pno ORDER BY y0, line_no)),
i AS (SELECT *, sum(coalesce((gap > greatest(6.0, ph * 1.6))::INT, 0)) OVER (PARTITION BY doc_id, pno ORDER BY y0, line_no ROWS UNBOUNDED PRECEDING) AS island FROM q),
s AS (SELECT doc_id, pno, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(tx, ' ' ORDER BY y0, line_no) AS t FROM i GROUP BY doc_id, pno, island)
SELECT doc_id, pno, x0 - 14 AS x0, y0 - 4 AS y0, round(x1 + 14, 6) AS x1, y1 + 4 AS y1, md5(t) AS text FROM s WHERE length(regexp_replace(t, '\\s', '', 'g')) >= 6 AND (regexp_matches(t, '[=≈≤≥∑∏∫→←⇒∂±×÷∼≡]') OR regexp_matches(t, '\\(\\d{{1,2}}\\)\\s*$'))""")
def equation_islands(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = _layout(spark, sf)
    n, down = F.col("line_no"), F.when(F.col("line_no") % 40 >= 20, 30).otherwise(0)
    rows = lines.withColumn("text", F.when(n % 3 == 1, F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" = x")))).withColumn("y0", F.col("y0") + down).withColumn("y1", F.col("y1") + down)
    return regions.equation_regions(rows).select("doc_id", "pno", "x0", "y0", F.round("x1", 6).alias("x1"), "y1", F.md5("text").alias("text"))


# Documents of even number are mathematics.
@query("math_dominant", f"""WITH {L}, {COVERED}, m AS (SELECT *, text || ' = x' AS tx, CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE math END AS mm FROM cov)
SELECT doc_id, pno FROM m GROUP BY doc_id, pno HAVING sum(length(tx) * mm) / sum(length(tx)) >= 0.5 AND length(regexp_replace(string_agg(tx, ' '), '\\s', '', 'g')) >= 6""")
def math_dominant(spark: SparkSession, sf: str) -> DataFrame:
    lines, _ = _layout(spark, sf)
    boxes = _boxes(lines).withColumn("t_id", F.struct("doc_id", "pno"))
    made = lines.withColumn("text", F.concat(F.col("text"), F.lit(" = x"))).withColumn("math", F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(F.col("math")))
    return regions.math_dominant(boxes, made).select("t_id.doc_id", "t_id.pno")


@query("region_plan")
def region_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every 20th line is a caption by place, and every page has a table and a drawing. tests/ hold the planner against loops."""
    lines, pages = _layout(spark, sf)
    made = lines.withColumn("text", F.when(F.col("line_no") % 20 == 13, F.concat(F.lit("Figure 1. "), F.col("text"))).otherwise(F.col("text")))
    graphics = pages.select("doc_id", "pno", F.lit(70.0).alias("x0"), F.lit(200.0).alias("y0"), F.lit(250.0).alias("x1"), F.lit(300.0).alias("y1"))
    planned = regions.plan(made, pages, _boxes(lines), graphics)
    return regions.crop(planned.join(pages, ["doc_id", "pno"])).select("doc_id", "pno", "name", "kind", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")], "rendered")


IMAGES = """im AS (SELECT doc_id, pno, (line_no % 50)::INT AS xref, x0, y0, x0 + 10.0 * (line_no % 40) AS x1, y0 + 10.0 * (line_no % 30) AS y1 FROM l),
pk AS (SELECT doc_id, pno, xref, y0, x0 FROM im WHERE (doc_id, xref) IN (SELECT (doc_id, xref) FROM im GROUP BY doc_id, xref HAVING count(DISTINCT pno) = 1) AND (x1 - x0) * (y1 - y0) / (530 * 800) BETWEEN 0.03 AND 0.60)"""


def _images(spark: SparkSession, sf: str) -> DataFrame:
    lines, pages = _layout(spark, sf)
    n = F.col("line_no")
    images = lines.select("doc_id", "pno", (n % 50).alias("xref"), "x0", "y0", (F.col("x0") + 10.0 * (n % 40)).alias("x1"), (F.col("y0") + 10.0 * (n % 30)).alias("y1"))
    return regions.pick_images(images, pages)


@query("pick_images", f"WITH {L}, {IMAGES} SELECT doc_id, pno, xref FROM pk")
def pick_images(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf).select("doc_id", "pno", "xref")


@query("save_images", f"WITH {L}, {IMAGES} SELECT doc_id, pno, 'doc-p' || lpad((pno + 1)::VARCHAR, 3, '0') || '-' || lpad((row_number() OVER (PARTITION BY doc_id, pno ORDER BY y0, x0, xref))::VARCHAR, 2, '0') || '.png' AS name FROM pk")
def save_images(spark: SparkSession, sf: str) -> DataFrame:
    return links.page_links(_images(spark, sf)).select("doc_id", "pno", "name")


# Links: every line of a document names a region, its kind by place -------------------------------------------------------------------


def _regions(spark: SparkSession, sf: str, shift: int) -> tuple[DataFrame, DataFrame]:
    paras = lines_of(spark, sf).where(F.col("text").rlike(r"(?U)\w"))  # those with a key; read three times, which is less than a copy
    n = F.col("idx").cast("long")
    kind = F.when(F.col("idx") % 7 == shift, F.lit("equation")).otherwise(F.lit("figure"))
    captioned = F.when(F.col("idx") % 7 == shift, F.col("text"))
    return paras, paras.select("doc_id", n.alias("n"), kind.alias("kind"), F.substring("text", 3, 30).alias("anchor"), captioned.alias("cap_text"), F.concat(F.lit("![]("), n.cast("string"), F.lit(")")).alias("link"))


PUT = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, rank, n) - 1 AS idx, md5(text) AS text FROM (
SELECT doc_id, idx AS pos, 0 AS rank, 0 AS n, t AS text FROM pa UNION ALL SELECT doc_id, coalesce(pos, 2147483647), CASE WHEN pos IS NULL THEN 2 ELSE 1 END, n, '![](' || n || ')' FROM hit)"""


@query("link_equations", rf"""WITH {U}, pa AS (SELECT * FROM u WHERE {KEY.format('t')} <> ''), fl AS (SELECT doc_id, idx, lower(regexp_replace(t, '{W}+', '', 'g')) AS f FROM pa), eq AS (SELECT doc_id, idx AS n, lower(regexp_replace(substr(t, 3, 30), '{W}+', '', 'g')) AS a FROM pa WHERE idx % 7 = 3),
hit AS (SELECT eq.doc_id, n, min(fl.idx) AS pos FROM eq LEFT JOIN fl ON fl.doc_id = eq.doc_id AND a <> '' AND contains(f, a) GROUP BY eq.doc_id, n) {PUT}""")
def link_equations(spark: SparkSession, sf: str) -> DataFrame:
    paras, made = _regions(spark, sf, 3)
    return links.link_equations(paras, made).select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("text"))


@query("link_captions", rf"""WITH RECURSIVE {U}, pa AS (SELECT * FROM u WHERE {KEY.format('t')} <> ''), ky AS (SELECT doc_id, idx, {KEY.format('t')} AS k FROM pa),
an AS (SELECT doc_id, k AS c, min(idx) AS n, max(idx) AS link FROM ky WHERE idx % 7 = 5 GROUP BY doc_id, k),
w AS (SELECT doc_id, idx, list(n ORDER BY n) AS ns, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i FROM an JOIN ky USING (doc_id) WHERE starts_with(k, left(c, 20)) GROUP BY doc_id, idx),
r AS (SELECT doc_id, i, idx, ns[1] AS n, [ns[1]] AS used FROM w WHERE i = 1 UNION ALL SELECT doc_id, i, idx, f, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END FROM (SELECT w.*, r.used, list_filter(w.ns, lambda x: NOT list_contains(r.used, x))[1] AS f FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1)),
hit AS (SELECT an.doc_id, an.n, an.link, r.idx AS pos FROM an LEFT JOIN r ON r.doc_id = an.doc_id AND r.n = an.n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, rank, n) - 1 AS idx, md5(text) AS text FROM (
SELECT doc_id, idx AS pos, 0 AS rank, 0 AS n, t AS text FROM pa UNION ALL SELECT doc_id, coalesce(pos, 2147483647), CASE WHEN pos IS NULL THEN 2 ELSE -1 END, n, '![](' || link || ')' FROM hit)""")
def link_captions(spark: SparkSession, sf: str) -> DataFrame:
    paras, made = _regions(spark, sf, 5)
    return links.link_captions(paras, made).select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("text"))


@query("link_images", rf"""WITH {U}, pa AS (SELECT * FROM u WHERE {KEY.format('t')} <> ''), ky AS (SELECT doc_id, idx, {KEY.format('t')} AS k FROM pa), im AS (SELECT doc_id, idx AS n, {KEY.format('t')} AS last FROM pa WHERE idx % 7 = 4),
hit AS (SELECT im.doc_id, n, min(ky.idx) AS pos FROM im LEFT JOIN ky ON ky.doc_id = im.doc_id AND contains(k, last) GROUP BY im.doc_id, n) {PUT}""")
def link_images(spark: SparkSession, sf: str) -> DataFrame:
    paras, made = _regions(spark, sf, 4)
    pno, made = F.col("n").cast("int").alias("pno"), made.where(F.col("kind") == "equation")  # those stand for images
    shown = made.select("doc_id", pno, F.lit(0).alias("n"), "link")
    last = made.select("doc_id", pno, T.key(F.col("cap_text")).alias("last_key"))
    return links.link_pages(paras, shown, last).select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("text"))


# Candidates ----------------------------------------------------------------------------------------------------------

CANDIDATES = f"""cd AS (SELECT doc_id, v.ord, avg(1)::DOUBLE AS one, sum({NORM_LEN.format('t')}) FILTER (idx % v.step <> v.step - 1) AS kept, sum({NORM_LEN.format('t')}) AS raw, count(*) FILTER (length(t) > 80) AS ck, count(*) FILTER (length(t) > 80 AND NOT {ENDS.format('t')}) AS bad
 FROM u, (VALUES (0, 5), (1, 40), (2, 20)) v(ord, step) GROUP BY doc_id, v.ord),
sc AS (SELECT doc_id, ord, (CASE WHEN raw > 0 THEN coalesce(kept, 0) / raw ELSE 0 END)::DOUBLE AS cov, (CASE WHEN ck > 0 THEN bad / ck ELSE 0 END)::DOUBLE AS tr FROM cd),
ok AS (SELECT *, cov >= 0.97 AND tr <= 0.05 AS ok, abs(1 - cov) + tr AS pen FROM sc),
w AS (SELECT a.doc_id, a.ok AS ok0, a.pen AS pen0, b.ok AS ok1, b.pen AS pen1, c.ok AS ok2, c.pen AS pen2 FROM ok a JOIN ok b ON b.doc_id = a.doc_id AND b.ord = 1 JOIN ok c ON c.doc_id = a.doc_id AND c.ord = 2 WHERE a.ord = 0),
s1 AS (SELECT *, CASE WHEN ok1 <> ok0 THEN ok1 ELSE pen1 < pen0 END AS t1 FROM w),
s2 AS (SELECT *, CASE WHEN t1 THEN ok1 ELSE ok0 END AS okb, CASE WHEN t1 THEN pen1 ELSE pen0 END AS penb FROM s1)"""


@query("candidate_tournament", f"WITH {U}, {CANDIDATES} SELECT doc_id, (CASE WHEN (CASE WHEN ok2 <> okb THEN ok2 ELSE pen2 < penb END) THEN 2 WHEN t1 THEN 1 ELSE 0 END)::INT AS ord FROM s2")
def candidate_tournament(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    n = T.norm_len(t)
    aggs = []
    for k, step in enumerate((5, 40, 20)):
        aggs.append(F.coalesce(F.sum(F.when(F.col("idx") % step != step - 1, n)), F.lit(0)).alias(f"kept{k}"))
    long = F.length(t) > 80
    sums = lines_of(spark, sf).repartition("doc_id").groupBy("doc_id").agg(*aggs, F.sum(n).alias("raw"), F.count_if(long).alias("ck"), F.count_if(long & ~T.ends_properly(t)).alias("bad"))
    cut = F.when(F.col("ck") > 0, F.col("bad") / F.col("ck")).otherwise(F.lit(0.0))
    made = []
    for k in range(3):
        cov = quality.coverage(F.col(f"kept{k}"), F.col("raw"), F.lit(0))
        made.append(F.struct(F.lit(k).alias("ord"), F.lit(f"c{k}").alias("name"), cov.alias("coverage"), cut.alias("truncated"), quality.passes(cov, cut).alias("ok"), F.lit(True).alias("keeps_tables")))
    return quality.tournament(sums.select("doc_id", F.explode(F.array(*made)).alias("c")).select("doc_id", "c.*")).select("doc_id", "ord")


# Three candidates and a fallback: one loses a line of five, one a line of 40 and keeps the table, one cuts the ends of some
# lines; every third document has a table, every fifth ends in a list of references.
GIVEN = r"""gv AS (SELECT doc_id, ord, string_agg(x, chr(10) || chr(10) ORDER BY idx) || CASE WHEN ord = 1 THEN chr(10) || chr(10) || '| a | b |' ELSE '' END AS x FROM (
 SELECT u.doc_id, v.ord, u.idx, CASE WHEN doc_id % 5 = 2 AND idx = 9 THEN '## References' WHEN v.ord = 2 AND idx % 4 = 1 THEN left(t, length(t) - 1) ELSE t END AS x FROM u, (VALUES (0, 5), (1, 40), (2, 1000000), (9, 30)) v(ord, step) WHERE idx % v.step <> v.step - 1) GROUP BY doc_id, ord),
cl AS (SELECT doc_id * 10 + ord AS doc_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '-----+\n', '', 'g'), '(?m)^(#{1,6})\s+\*\*(.+?)\*\*\s*$', '\1 \2', 'g'), '(?m)[ \t]+$', '', 'g'), chr(173), ''), '^\s+|\s+$', '', 'g') || chr(10) AS x FROM gv),
b AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS t FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_split_to_array(x, '(?im)^#*\s*(references|참고문헌|bibliography)\s*$')[1], chr(10) || chr(10)), lambda q: regexp_replace(q, '^\s+|\s+$', '', 'g')), lambda q: q <> '') AS l FROM cl))"""
CHOSEN = f"""e AS (SELECT doc_id, count(*) AS checked, count(*) FILTER (NOT {ENDS.format('t')}) AS bad FROM c GROUP BY doc_id),
rw AS (SELECT doc_id, sum({NORM_LEN.format('t')}) AS raw FROM u GROUP BY doc_id),
sc AS (SELECT cl.doc_id // 10 AS doc_id, (cl.doc_id % 10)::INT AS ord, x, (CASE WHEN raw > 0 THEN {NORM_LEN.format('x')} / raw ELSE 0 END)::DOUBLE AS cov, coalesce(bad / checked, 0)::DOUBLE AS tr, cl.doc_id // 10 % 3 > 0 OR cl.doc_id % 10 = 1 AS kt FROM cl LEFT JOIN e ON e.doc_id = cl.doc_id JOIN rw ON rw.doc_id = cl.doc_id // 10),
ok AS (SELECT *, cov >= 0.97 AND tr <= 0.05 AS ok, abs(1 - cov) + tr AS pen FROM sc),
w AS (SELECT a.doc_id, a AS a, b AS b, c AS c, f AS f FROM ok a JOIN ok b ON b.doc_id = a.doc_id AND b.ord = 1 JOIN ok c ON c.doc_id = a.doc_id AND c.ord = 2 JOIN ok f ON f.doc_id = a.doc_id AND f.ord = 9 WHERE a.ord = 0),
w1 AS (SELECT doc_id, CASE WHEN CASE WHEN b.kt <> a.kt THEN b.kt AND b.ok WHEN b.ok <> a.ok THEN b.ok ELSE b.pen < a.pen END THEN b ELSE a END AS a, c, f FROM w),
w2 AS (SELECT doc_id, CASE WHEN CASE WHEN c.kt <> a.kt THEN c.kt AND c.ok WHEN c.ok <> a.ok THEN c.ok ELSE c.pen < a.pen END THEN c ELSE a END AS a, f FROM w1),
w3 AS (SELECT doc_id, CASE WHEN NOT a.ok AND CASE WHEN f.ok <> a.ok THEN f.ok ELSE f.pen < a.pen END THEN f ELSE a END AS a FROM w2)"""


@query("extract_candidates", f"WITH {U}, {GIVEN}, {CHECKED}, {CHOSEN} SELECT doc_id, CASE a.ord WHEN 0 THEN 'lines' WHEN 1 THEN 'tables' WHEN 2 THEN 'columns' ELSE 'older' END AS name, round(a.cov, 6) AS coverage, round(a.tr, 6) AS truncated, a.ok AS ok, a.ok AS gate_ok, md5(a.x) AS text FROM w3")
def extract_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t, i = F.col("text"), F.col("idx")
    rows = lines_of(spark, sf).repartition("doc_id")
    text = F.when((F.col("doc_id") % 5 == 2) & (i == 9), "## References").otherwise(t)
    less = F.when((F.col("doc_id") % 5 == 2) & (i == 9), "## References").when(i % 4 == 1, F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    joined = lambda c, step: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(i % step != step - 1, F.struct("idx", c.alias("t"))))), lambda x: x["t"]), "\n\n")
    made = rows.groupBy("doc_id").agg(joined(text, 5).alias("lines"), F.concat(joined(text, 40), F.lit("\n\n| a | b |")).alias("tables"), joined(less, 1_000_000).alias("columns"), joined(text, 30).alias("older"))
    of = lambda *names: made.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), F.col(n).alias("text")) for k, n in enumerate(names)])).alias("c")).select("doc_id", "c.*")
    found = api.extract(of("lines", "tables", "columns"), docs(spark, sf).select("doc_id", "text"), fallback=of("older"), has_tables=docs(spark, sf).select("doc_id", (F.col("doc_id") % 3 == 0).alias("has_tables")))
    return found.select("doc_id", "name", F.round("coverage", 6).alias("coverage"), F.round("truncated", 6).alias("truncated"), "ok", "gate_ok", F.md5("text").alias("text"))


def _with_regions(text: Column) -> Column:
    """A text with what the regions' plan looks for, by place: captions of figures and tables, and operators in the lines
    that document_lines makes mathematics."""
    named = lambda kind, t, i: F.concat(F.lit(f"{kind} "), (F.floor(i / 20) + 1).cast("string"), F.lit(". "), t)
    mark = lambda t, i: F.when(i % 40 == 13, named("Figure", t, i)).when(i % 40 == 33, named("Table", t, i)).when(i % 17 == 0, F.concat(t, F.lit(" = x"))).otherwise(t)
    return F.array_join(F.transform(F.split(text, "\n"), mark), "\n")


@query("postprocess_candidates")
def postprocess_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: two candidates of each document set right over one layout with captions, tables, formulas, drawings
    and placed images, scored with what was taken out of each, and the older extraction where neither passes. Each page has
    a table, one that may be a formula, and a drawing. tests/ hold it against runs of each candidate by itself, and ask of
    the regions' steps that they count."""
    whole = docs(spark, sf).select("doc_id", _with_regions(F.col("text")).alias("text"))
    lines, n = document_lines(whole), F.col("line_no")
    pages = pages_of(lines)
    box = lambda *at: pages.select("doc_id", "pno", *[F.lit(v).alias(c) for c, v in zip(regions.BOX, at)])
    tables, graphics = _boxes(lines).unionByName(box(40.0, 365.0, 270.0, 378.0)), box(300.0, 130.0, 500.0, 240.0)
    images = lines.select("doc_id", "pno", (n % 50).alias("xref"), "x0", "y0", (F.col("x0") + 10.0 * (n % 40)).alias("x1"), (F.col("y0") + 10.0 * (n % 30)).alias("y1"))
    named = lambda name, k, c: whole.select("doc_id", F.lit(k).alias("ord"), F.lit(name).alias("name"), c.alias("text"))
    given = named("lines", 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).unionByName(named("banner", 1, F.concat(F.lit("all use subject to terms and conditions\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))))
    made, dropped = api.postprocess_candidates(given, lines, pages, tables=tables, graphics=graphics, images=images)
    older, older_dropped = api.stitched(whole)
    found = api.extract(made, whole, older, dropped=dropped, has_tables=whole.select("doc_id", (F.col("doc_id") % 3 == 0).alias("has_tables")), fallback_dropped=older_dropped)
    return found.select("doc_id", "name", F.round("coverage", 6).alias("coverage"), F.round("truncated", 6).alias("truncated"), "ok", "gate_ok", F.md5("text").alias("text"))


# Checks of pairs -----------------------------------------------------------------------------------------------------

# Turns carry no numbers, so some are put in front by turn and conversation.
PAIRS = P.replace("a.text AS s", "'In ' || (1990 + a.conv_id % 30) || ' and ' || (a.turn % 5) || ' (Smith, ' || (1980 + a.turn) || ') ' || a.text AS s").replace("b.text AS r", "'By ' || (1990 + b.conv_id % 29) || ' (Smith, ' || (1980 + b.turn % 3) || ') ' || b.text AS r")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    s = lambda c: c.cast("string")
    d, i = F.col("doc_id"), F.col("id")
    return pairs.withColumn("source", F.concat(F.lit("In "), s(1990 + d % 30), F.lit(" and "), s(i % 5), F.lit(" (Smith, "), s(1980 + i), F.lit(") "), F.col("source"))).withColumn(
        "translation", F.concat(F.lit("By "), s(1990 + d % 29), F.lit(" (Smith, "), s(1980 + (i + 1) % 3), F.lit(") "), F.col("translation"))
    )


def pair_query(name: str, of: Callable[[], Column], sql: str) -> None:
    query(name, f"WITH {PAIRS} SELECT doc_id, id, {sql} AS value FROM p")(lambda spark, sf: _pairs(spark, sf).select("doc_id", "id", of().alias("value")))


S2 = r"list_aggregate(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), 'string_agg', ',')"
pair_query("check_numbers", lambda: F.array_join(checks.missing_numbers(), ","), "coalesce(" + S2.format(a=NUMBERS.format("s"), b=NUMBERS.format("r")) + ", '')")
pair_query("check_integers", lambda: F.array_join(checks.missing_integers(), ","), "coalesce(" + S2.format(a=INTEGERS.format("s").replace(r"\d+'", r"\d{1,3}|\d{5,}'"), b=INTEGERS.format("r")) + ", '')")
CITES = Sql(r"list_distinct(regexp_extract_all({0}, '\([A-Z][A-Za-z&.\- ]+?,\s*\d{{4}}[a-z]?\)'))")
pair_query("check_citations", lambda: F.array_join(F.transform(checks.missing_citations(), lambda c: F.concat(F.lit("("), c["author"], F.lit(", "), c["year"], F.lit(")"))), ","), "coalesce(" + S2.format(a=CITES.format("s"), b=CITES.format("r")) + ", '')")
pair_query("check_paragraphs", lambda: checks.count_blocks(F.replace("source", F.lit("\n"), F.lit("\n\n"))) == checks.count_blocks(F.replace("translation", F.lit("\n"), F.lit("\n\n"))), f"len({UNITS.format('replace(s, chr(10), chr(10) || chr(10))')}) = len({UNITS.format('replace(r, chr(10), chr(10) || chr(10))')})")
pair_query("check_headings", lambda: checks.count_headings(F.concat(F.lit("# "), F.replace("source", F.lit(" de"), F.lit("\n# ")))).cast("long"), r"len(regexp_extract_all('# ' || replace(s, ' de', chr(10) || '# '), '(?m)^#{1,6}\s'))")
pair_query("check_table_rows", lambda: checks.count_table_rows(F.replace("source", F.lit(" the"), F.lit("\n|"))).cast("long"), r"len(list_filter(string_split(replace(s, ' the', chr(10) || '|'), chr(10)), lambda x: starts_with(x, '|')))::BIGINT")
pair_query("check_footnotes", lambda: F.size(checks.untranslated_footnotes(F.replace(F.concat(F.lit("> "), F.col("translation")), F.lit("\n"), F.lit("\n\n> ")))).cast("long"), rf"len(list_filter({UNITS.format("replace('> ' || r, chr(10), chr(10) || chr(10) || '> ')")}, lambda x: starts_with(x, '>') AND length(x) > 40 AND NOT regexp_matches(x, '[가-힣]')))::BIGINT")
pair_query("check_hangul_ratio", lambda: T.hangul_ratio(F.concat(F.col("translation"), F.lit("가나다"))), r"(3 / len(regexp_extract_all(r || '가나다', '[A-Za-z가-힣]')))::DOUBLE")
pair_query("check_english_left", lambda: F.size(checks.english_left(F.replace("translation", F.lit("\n"), F.lit("\n\n")))).cast("long"), r"len(list_filter(string_split(replace(r, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: length(x) > 200 AND NOT regexp_matches(x, '[가-힣]') AND NOT regexp_matches(x, '^([|!$]|```)')))::BIGINT")
pair_query("check_images", lambda: F.size(checks.missing_image_links(F.concat(F.col("source"), F.lit(" ![a](images/x.png) ![b](images/"), F.col("id").cast("string"), F.lit(".png)")), F.concat(F.col("translation"), F.lit(" images/1.png")))).cast("long"), r"(1 + CASE WHEN contains(r || ' images/1.png', 'images/' || id || '.png') THEN 0 ELSE 1 END)::BIGINT")
pair_query("check_references", lambda: checks.is_references(F.replace("source", F.lit("\n"), F.lit("\n- ["))), r"coalesce(len(list_filter(string_split(replace(s, chr(10), chr(10) || '- ['), chr(10)), lambda x: regexp_matches(x, '^-\s*\['))) / nullif(len(list_filter(string_split(replace(s, chr(10), chr(10) || '- ['), chr(10)), lambda x: trim(x) <> '')), 0) > 0.5, false)")


LACKS = "len(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
REFS = r"(regexp_matches(s, '(?im)^#+\s*(References|참고문헌)') OR coalesce(len(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '^-\s*\['))) / nullif(len(list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '')), 0) > 0.5, false))"
HANGUL_SHARE = "len(regexp_extract_all(r, '[가-힣]')) / nullif(len(regexp_extract_all(r, '[A-Za-z가-힣]')), 0)"
VERIFIED = rf"""v AS (SELECT doc_id, id, {LACKS.format(a=NUMBERS.format('s'), b=NUMBERS.format('r'))} + {LACKS.format(a=CITES.format('s'), b=CITES.format('r'))} + (len({UNITS.format('s')}) <> len({UNITS.format('r')}))::INT
 + len(list_filter({UNITS.format('r')}, lambda x: starts_with(x, '>') AND length(x) > 40 AND NOT regexp_matches(x, '[가-힣]'))) + (len(regexp_extract_all(s, '(?m)^#{{1,6}}\s')) <> len(regexp_extract_all(r, '(?m)^#{{1,6}}\s')))::INT
 + (len(list_filter(string_split(s, chr(10)), lambda x: starts_with(x, '|'))) <> len(list_filter(string_split(r, chr(10)), lambda x: starts_with(x, '|'))))::INT
 + CASE WHEN {REFS} THEN 0 ELSE coalesce({HANGUL_SHARE} < 0.5, false)::INT + len(list_filter(string_split(r, chr(10) || chr(10)), lambda x: length(x) > 200 AND NOT regexp_matches(x, '[가-힣]') AND NOT regexp_matches(x, '^([|!$]|```)'))) END AS problems,
 {"coalesce(" + S2.format(a=INTEGERS.format("s").replace(chr(92) + "d+'", chr(92) + "d{1,3}|" + chr(92) + "d{5,}'"), b=INTEGERS.format("r")) + ", '')"} AS warnings FROM p)"""


@query("verify_verdict", f"WITH {PAIRS}, {VERIFIED} SELECT doc_id, count(*) AS chunks, count(*) FILTER (problems > 0) AS failed, bool_and(problems = 0) AS ok FROM v GROUP BY doc_id")
def verify_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return checks.verdict(checks.verify(_pairs(spark, sf)))


@query("verify_problems", f"WITH {PAIRS}, {VERIFIED} SELECT doc_id, id, problems::INT AS problems, warnings, problems = 0 AS ok FROM v")
def verify_problems(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.verify(_pairs(spark, sf))
    return found.select("doc_id", "id", F.size("problems").alias("problems"), F.array_join("warnings", ",").alias("warnings"), "ok")


@query("assemble", r"WITH q AS (SELECT conv_id AS doc_id, bool_and(turn % 50 <> 49) AS complete, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) || chr(10) AS t FROM conversations GROUP BY conv_id) SELECT doc_id, complete, CASE WHEN complete THEN md5(t) END AS text FROM q")
def assemble(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.col("text").alias("translation"))
    return checks.assemble(turns, turns.where(F.col("id") % 50 != 49)).select("doc_id", "complete", F.md5("text").alias("text"))


YEARS = Sql(r"list_distinct(list_filter(regexp_extract_all({0}, '[0-9.]+'), lambda x: regexp_full_match(x, '\d{{4}}')))")
FINAL = rf"""w AS (SELECT doc_id, arg_min(s, id) AS s, arg_min(r, id) AS r, count(*) AS c FROM p GROUP BY doc_id),
f AS (SELECT doc_id, c, len({UNITS.format('s')}) AS ns, len({UNITS.format('r')}) AS nt, len(regexp_extract_all(r, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS im,
 list_sort(list_filter({YEARS.format('s')}, lambda x: NOT list_contains({YEARS.format('r')}, x))) AS ys,
 len(list_filter({UNITS.format('r')}, lambda x: starts_with(x, '>') AND length(x) > 40 AND NOT regexp_matches(x, '[가-힣]'))) AS notes,
 len(list_filter(string_split(r, chr(10) || chr(10)), lambda x: length(trim(x, ' ' || chr(10) || chr(9) || chr(13))) > 80 AND NOT regexp_matches(x, '^\s*[#>!|]') AND NOT regexp_matches(x, '[가-힣]'))) AS lf FROM w),
g AS (SELECT doc_id, unnest([
 {{'n': 0, 'item': 'untranslated footnotes', 'value': notes::VARCHAR, 'criterion': '0', 'ok': notes = 0}},
 {{'n': 1, 'item': 'untranslated paragraphs', 'value': lf::VARCHAR, 'criterion': '0', 'ok': lf = 0}},
 {{'n': 2, 'item': 'paragraphs', 'value': ns || '→' || nt, 'criterion': 'within 2 %', 'ok': ns = 0 OR abs(ns - nt) <= greatest(2.0, ns * 0.02)}},
 {{'n': 3, 'item': 'missing years', 'value': len(ys) || ' ' || array_to_string(ys[1:5], ','), 'criterion': '0', 'ok': len(ys) = 0}},
 {{'n': 4, 'item': 'image links', 'value': im || ', broken ' || im, 'criterion': 'broken 0', 'ok': im = 0}},
 {{'n': 5, 'item': 'html images', 'value': '0 / 0', 'criterion': 'all inlined', 'ok': 0 >= im}},
 {{'n': 6, 'item': 'files', 'value': c || ' / ' || c || ' / ' || (c - 1), 'criterion': 'translated = chunks', 'ok': true}},
 {{'n': 7, 'item': 'chunks without review', 'value': '1', 'criterion': '0', 'ok': true}},
 {{'n': 8, 'item': 'coverage', 'value': '0.98', 'criterion': '≥0.97', 'ok': true}},
 {{'n': 9, 'item': 'truncated', 'value': '0.06', 'criterion': '≤0.05', 'ok': false}},
 {{'n': 10, 'item': 'extractor', 'value': 'columns', 'criterion': '-', 'ok': true}},
 {{'n': 11, 'item': 'figures', 'value': '2', 'criterion': '-', 'ok': true}}]) AS x FROM f),
h AS (SELECT doc_id, x.n AS n, x.item AS item, x.value AS value, x.criterion AS criterion, x.ok AS ok FROM g)"""


@query("final_check", f"WITH {PAIRS}, {FINAL} SELECT doc_id, n::INT AS n, item, value, criterion, ok FROM h")
def final_check(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    works = pairs.groupBy("doc_id").agg(F.min_by("source", "id").alias("source"), F.min_by("translation", "id").alias("ko"), F.count("*").alias("chunks"))
    works = works.select("*", F.lit("<img src='x'>").alias("html"), F.array().cast("array<string>").alias("files"), F.col("chunks").alias("translated"), (F.col("chunks") - 1).alias("reviewed"), F.lit(0.98).alias("coverage"), F.lit(0.06).alias("truncated"), F.lit("columns").alias("extractor"), F.lit(2).alias("figures"))
    return checks.final_check(works)


@query("final_report", f"""WITH {PAIRS}, {FINAL} SELECT doc_id, bool_and(ok) AS ok, '# Final check' || chr(10) || chr(10) || CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END || chr(10) || chr(10) || '| item | value | criterion | verdict |' || chr(10) || '|---|---|---|---|' || chr(10)
 || string_agg('| ' || item || ' | ' || value || ' | ' || criterion || ' | ' || CASE WHEN ok THEN 'ok' ELSE 'FAIL' END || ' |', chr(10) ORDER BY n) || chr(10)
 || CASE WHEN bool_and(ok) THEN '' ELSE chr(10) || '## Failed' || chr(10) || chr(10) || string_agg('- ' || item || ': ' || value || ' (' || criterion || ')', chr(10) ORDER BY n) FILTER (NOT ok) || chr(10) END AS report FROM h GROUP BY doc_id""")
def final_report(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_report(final_check(spark, sf))


# All pairs of a conversation as one work, with a picture in some sources and translations; which artefacts it has, and how far
# they go, differs by its number, so that each rule holds for some and not for others.
WORKS = FINAL.replace("w AS (SELECT doc_id, arg_min(s, id) AS s, arg_min(r, id) AS r, count(*) AS c FROM p GROUP BY doc_id)", """w AS (SELECT doc_id, string_agg(s, chr(10) || chr(10) ORDER BY id) || CASE WHEN doc_id % 6 = 0 THEN chr(10) || chr(10) || '# 용어 대응표' ELSE '' END AS s,
 string_agg(r, chr(10) || chr(10) ORDER BY id) || CASE WHEN doc_id % 3 > 0 THEN ' ![f](images/' || doc_id || '.png)' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) || '> **각주 1** ' || repeat('note ', 10) ELSE '' END
 || CASE WHEN doc_id % 6 = 0 THEN chr(10) || chr(10) || '# 용어 대응표' || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || 'b' ELSE '' END AS r, count(*) AS c FROM p GROUP BY doc_id),
w1 AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 9 THEN '한글 번역' ELSE r END AS r) FROM w), w2 AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 3 THEN r WHEN doc_id % 5 = 2 THEN s || repeat(chr(10) || chr(10) || 'x', 9) ELSE s END AS s) FROM w1)""")
WORKS = WORKS.replace("AS lf FROM w)", "AS lf FROM w2)").replace("starts_with(x, '>') AND length(x) > 40", "starts_with(x, '>') AND length(regexp_replace(x, '^>\\s*\\*\\*각주[^*]*\\*\\*\\s*', '')) > 40").replace("AND NOT regexp_matches(x, '[가-힣]'))) AS notes", "AND NOT regexp_matches(regexp_replace(x, '^>\\s*\\*\\*각주[^*]*\\*\\*\\s*', ''), '[가-힣]'))) AS notes")
WORKS = WORKS[: WORKS.index("g AS (SELECT")].replace("SELECT doc_id, c, len(", "SELECT doc_id, c, r, len(", 1).replace(UNITS.format("r") + ") AS nt", UNITS.format("regexp_split_to_array(r, '(?im)^#*\\s*용어\\s*대응표')[1]") + ") AS nt") + r"""
v AS (SELECT *, doc_id % 7 = 0 AS lost, doc_id % 5 > 0 AS html, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS pl, CASE WHEN doc_id % 5 IN (2, 3) THEN im ELSE 0 END AS inl, CASE WHEN doc_id % 2 = 0 THEN im ELSE 0 END AS br, doc_id % 4 < 3 AS idx,
 (c - (doc_id % 4 = 1)::INT) AS tr, (c - (doc_id % 3 = 1)::INT) AS rv, doc_id % 9 > 0 AS meta, round(0.9 + (doc_id % 11) / 100, 2) AS cov, round((doc_id % 8) / 100, 2) AS cut FROM f),
g AS (SELECT doc_id, unnest(list_filter([
 {'item': 'translation', 'value': 'none', 'criterion': 'required', 'ok': false, 'there': lost},
 {'item': 'untranslated footnotes', 'value': notes::VARCHAR, 'criterion': '0', 'ok': notes = 0, 'there': NOT lost},
 {'item': 'untranslated paragraphs', 'value': lf::VARCHAR, 'criterion': '0', 'ok': lf = 0, 'there': NOT lost},
 {'item': 'paragraphs', 'value': ns || '→' || nt, 'criterion': 'within 2 %', 'ok': ns = 0 OR abs(ns - nt) <= greatest(2.0, ns * 0.02), 'there': NOT lost},
 {'item': 'missing years', 'value': len(ys) || ' ' || array_to_string(ys[1:5], ','), 'criterion': '0', 'ok': len(ys) = 0, 'there': NOT lost},
 {'item': 'image links', 'value': im || ', broken ' || br, 'criterion': 'broken 0', 'ok': br = 0, 'there': NOT lost},
 {'item': 'html images', 'value': inl || ' / ' || pl, 'criterion': 'all inlined', 'ok': pl = 0 AND inl >= im, 'there': NOT lost AND html},
 {'item': 'html', 'value': 'none', 'criterion': 'required', 'ok': false, 'there': NOT lost AND NOT html},
 {'item': 'files', 'value': c || ' / ' || tr || ' / ' || rv, 'criterion': 'translated = chunks', 'ok': tr >= c, 'there': NOT lost AND idx},
 {'item': 'chunks without review', 'value': (c - rv)::VARCHAR, 'criterion': '0', 'ok': true, 'there': NOT lost AND idx AND rv < c},
 {'item': 'coverage', 'value': cov::DOUBLE::VARCHAR, 'criterion': '≥0.97', 'ok': cov >= 0.97, 'there': NOT lost AND meta},
 {'item': 'truncated', 'value': cut::DOUBLE::VARCHAR, 'criterion': '≤0.05', 'ok': cut <= 0.05, 'there': NOT lost AND meta},
 {'item': 'extractor', 'value': CASE WHEN doc_id % 2 = 0 THEN 'columns' ELSE '?' END, 'criterion': '-', 'ok': true, 'there': NOT lost AND meta},
 {'item': 'figures', 'value': '2', 'criterion': '-', 'ok': true, 'there': NOT lost AND meta}], lambda x: x.there)) AS x FROM v)"""


@query("final_check_works", f"WITH {PAIRS}, {WORKS} SELECT doc_id, x.item AS item, x.value AS value, x.criterion AS criterion, x.ok AS ok FROM g")
def final_check_works(spark: SparkSession, sf: str) -> DataFrame:
    d, s = F.col("doc_id"), F.lit
    of = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.col(c).alias("t")))), lambda x: x["t"]), "\n\n")
    works = _pairs(spark, sf).groupBy("doc_id").agg(of("source").alias("source"), of("translation").alias("ko"), F.count("*").alias("chunks"))
    when = lambda test, text: F.when(test, text).otherwise(s(""))
    file = F.concat(s("images/"), d.cast("string"), s(".png"))
    ko = F.concat("ko", when(d % 3 > 0, F.concat(s(" ![f]("), file, s(")"))), when(d % 4 == 0, s("\n\n> **각주 1** " + "note " * 10)), when(d % 6 == 0, s("\n\n# 용어 대응표\n\na\n\nb")))
    works = works.withColumn("source", F.concat("source", when(d % 6 == 0, s("\n\n# 용어 대응표")))).withColumn("ko", F.when(d % 10 == 9, "한글 번역").otherwise(ko))
    works = works.withColumn("source", F.when(d % 5 == 3, F.col("ko")).when(d % 5 == 2, F.concat("source", s("\n\nx" * 9))).otherwise(F.col("source"))).withColumn("ko", F.when(d % 7 > 0, F.col("ko"))).withColumn("links", (d % 3 > 0).cast("int"))
    pages = F.when(d % 5 == 1, '<img alt="a" src="b.png">').when(d % 5 == 4, "<p>no image</p>").when(d % 5 > 0, F.repeat(s("<img src='data:image/png;base64,'>"), F.col("links")))
    index = lambda c: F.when(d % 4 < 3, c)
    meta = lambda c: F.when(d % 9 > 0, c)
    made = works.select(
        "doc_id", "source", "ko", pages.alias("html"), F.when(d % 2 > 0, F.array(file)).otherwise(F.array().cast("array<string>")).alias("files"), index(F.col("chunks")).alias("chunks"), index(F.col("chunks") - (d % 4 == 1).cast("int")).alias("translated"),
        index(F.col("chunks") - (d % 3 == 1).cast("int")).alias("reviewed"), meta(F.round(0.9 + (d % 11) / 100, 2)).alias("coverage"), meta(F.round((d % 8) / 100, 2)).alias("truncated"), meta(F.when(d % 2 == 0, "columns")).alias("extractor"), meta(s(2)).alias("figures"),
    )
    return checks.final_check(made).drop("n")


# A picture in each source, whose link and file are there or not by the turn's number.
@query("check_image_files", f"""WITH {PAIRS}, q AS (SELECT doc_id, id, doc_id % 3 > 0 AS linked, (doc_id + id) % 4 > 0 AS there FROM p)
SELECT doc_id, id, CASE WHEN NOT linked THEN 'missing image link images/' || id || '.png' WHEN NOT there THEN 'image file not found: images/' || id || '.png' ELSE '' END AS value FROM q""")
def check_image_files(spark: SparkSession, sf: str) -> DataFrame:
    d, i = F.col("doc_id"), F.col("id")
    file = F.concat(F.lit("images/"), i.cast("string"), F.lit(".png"))
    link = F.concat(F.lit(" ![f]("), file, F.lit(")"))
    pairs = _pairs(spark, sf).withColumn("source", F.concat("source", link)).withColumn("translation", F.when(d % 3 > 0, F.concat("translation", link)).otherwise(F.col("translation")))
    files = pairs.where((d + i) % 4 > 0).select("doc_id", file.alias("path"))
    found = checks.verify(pairs, files)
    return found.select("doc_id", "id", F.array_join(F.filter("problems", lambda x: x.rlike("^(missing image|image file)")), ",").alias("value"))


# Pages ---------------------------------------------------------------------------------------------------------------


@query("html_title", r"SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '""'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title FROM pages".replace('""', '"'))
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query("html_image_counts", r"WITH m AS (SELECT page_id, replace(replace(html, '<li>', '<img src=""data:image/png;x"">'), '<b>', '<img alt=""a"" src=""b.png"">') AS h FROM pages) SELECT page_id, len(regexp_extract_all(h, 'data:image'))::BIGINT AS inlined, (len(regexp_extract_all(h, '<img[^>]+src=""')) - len(regexp_extract_all(h, '<img[^>]+src=""data:')))::BIGINT AS plain FROM m".replace('""', '"'))
def html_image_counts(spark: SparkSession, sf: str) -> DataFrame:
    made = F.replace(F.replace("html", F.lit("<li>"), F.lit('<img src="data:image/png;x">')), F.lit("<b>"), F.lit('<img alt="a" src="b.png">'))
    inlined, plain = html.image_counts(made)
    return table(spark, sf, "pages").select("page_id", inlined.cast("long").alias("inlined"), plain.cast("long").alias("plain"))


UNESCAPE = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("html_blocks", rf"""WITH a AS (SELECT page_id, CASE WHEN regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) ELSE html END AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<h([1-6])[^>]*>', chr(1) || '#\1 ', 'g'), '(?i)<li[^>]*>', chr(1) || '- ', 'g') AS h FROM b),
d AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(?i)</?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|blockquote)[^>]*>', chr(1), 'g'), '<[^>]+>', '', 'g'), chr(1)) AS l FROM c),
e AS (SELECT page_id, list_filter(list_transform(l, lambda x: regexp_replace({UNESCAPE.replace('{0}', 'x')}, '^\s+|\s+$', '', 'g')), lambda x: x NOT IN ('', '-')) AS l FROM d),
f AS (SELECT page_id, unnest(range(len(l)))::INT AS idx, unnest(l) AS x FROM e)
SELECT page_id, idx, CASE WHEN regexp_matches(x, '^#[1-6] ') THEN repeat('#', substr(x, 2, 1)::INT) || substr(x, 3) ELSE x END AS text FROM f""")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return html.html_blocks(table(spark, sf, "pages"))


# Lines made headings, nested items, text that goes on, quotations, tables with and without heads, and code with blank lines.
MARKED = r"""md AS (SELECT doc_id, idx AS i, CASE (idx % 12)::INT WHEN 0 THEN '# ' || t WHEN 1 THEN '- ' || t WHEN 2 THEN '    - *' || t || '*' WHEN 3 THEN '  1. ' || t WHEN 4 THEN 'on **it** goes ' || t WHEN 5 THEN ''
 WHEN 6 THEN '> ' || t WHEN 7 THEN '| `a` | ' || t || ' |' WHEN 8 THEN CASE WHEN idx % 24 = 8 THEN '|---|---|' ELSE '| c |' END WHEN 9 THEN '```' WHEN 10 THEN t || chr(10) || chr(10) || t ELSE '```' END AS x FROM u),
ml AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS i, x FROM (SELECT doc_id, i, unnest(range(len(l))) AS k, unnest(l) AS x FROM (SELECT doc_id, i, string_split(x, chr(10)) AS l FROM md)))"""


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    t, s = F.col("text"), lambda x: F.lit(x)
    forms = [
        F.concat(s("# "), t), F.concat(s("- "), t), F.concat(s("    - *"), t, s("*")), F.concat(s("  1. "), t), F.concat(s("on **it** goes "), t), s(""), F.concat(s("> "), t), F.concat(s("| `a` | "), t, s(" |")),
        F.when(F.col("idx") % 24 == 8, "|---|---|").otherwise("| c |"), s("```"), F.concat(t, s("\n\n"), t), s("```"),
    ]
    made = lines_of(spark, sf).select("doc_id", "idx", F.element_at(F.array(*forms), (F.col("idx") % 12 + 1).cast("int")).alias("text"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    return made.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))


def _inline_sql(x: str) -> str:
    for pattern, put in html.MARKS:
        put = put.replace("$", chr(92))
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return x


def _render_sql() -> str:
    kinds = " ".join(f"WHEN regexp_matches(x, '{pattern}') THEN '{name}'" for name, pattern in html.KINDS)
    run = "OVER (PARTITION BY doc_id ORDER BY i)"
    inside = "OVER (PARTITION BY doc_id, block ORDER BY i)"
    lists = ", ".join(f"CASE WHEN last_value(CASE WHEN kind = 'item' AND depth > above AND depth = {k} THEN ordered END IGNORE NULLS) {inside} THEN 'ol' ELSE 'ul' END" for k in range(1, html.LEVELS + 1))
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    e = "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    cells = lambda tag: f"'<tr>' || array_to_string(list_transform(string_split(regexp_replace({strip('e')}, '^\\||\\|$', '', 'g'), '|'), lambda v: '<{tag}>' || {_inline_sql(strip('v'))} || '</{tag}>'), '') || '</tr>'"
    shut = "CASE WHEN goes_on OR below > depth THEN '' ELSE '</li>' || coalesce(array_to_string(list_transform(range(depth, below, -1), lambda d: '</' || lists[d] || CASE WHEN d = 1 AND below = 0 THEN '>' ELSE '></li>' END), ''), '') END"
    opened = lambda tag, c: f"CASE WHEN nth = 1 THEN '<{tag}>' ELSE '' END || {c} || CASE WHEN last THEN '</{tag}>' ELSE '' END"
    return rf"""WITH {U}, {MARKED},
a1 AS (SELECT *, sum(starts_with(x, '```')::INT) {run} AS f FROM ml),
a2 AS (SELECT *, CASE WHEN starts_with(x, '```') THEN CASE WHEN f % 2 = 1 THEN 'open' ELSE 'shut' END WHEN f % 2 = 1 THEN 'code' WHEN {strip('x')} = '' THEN 'blank' {kinds} ELSE 'text' END AS k0 FROM a1),
a3 AS (SELECT *, CASE WHEN k0 = 'text' AND last_value(CASE WHEN k0 <> 'text' THEN k0 END IGNORE NULLS) {run} = 'item' THEN 'more' ELSE k0 END AS kind FROM a2),
a4 AS (SELECT *, CASE WHEN kind = 'more' THEN 'item' ELSE kind END AS class FROM a3),
a5 AS (SELECT *, coalesce((class IN ('head', 'rule', 'open', 'shut', 'blank') OR class <> lag(class) {run})::INT, 1) AS new FROM a4),
a6 AS (SELECT *, sum(new) {run} AS block FROM a5),
a7 AS (SELECT *, row_number() {inside} AS nth, sum((kind = 'item')::INT) {inside} AS items, lead(i) {inside} IS NULL AS last, coalesce(lead(kind) {inside} = 'more', false) AS goes_on,
  last_value(CASE WHEN kind = 'item' THEN regexp_matches(x, '^\s*\d') END IGNORE NULLS) {inside} AS ordered, regexp_matches(x, '^\|?[\s:|-]*-[\s:|-]*$') AS dash FROM a6),
a8 AS (SELECT *, CASE WHEN class = 'item' THEN least(min(CASE WHEN kind = 'item' THEN CASE WHEN items = 1 THEN 1 ELSE 1 + length(regexp_extract(x, '^(\s*)', 1)) // 2 END - items END) {inside} + items, {html.LEVELS})::INT END AS depth,
  kind = 'table' AND nth = 1 AND coalesce(lead(dash) {inside}, false) AS headed, kind = 'table' AND nth = 2 AND dash AS dashes FROM a7),
a9 AS (SELECT *, coalesce(lead(depth) {inside}, 0) AS below, coalesce(lag(depth) {inside}, 0) AS above FROM a8),
b1 AS (SELECT *, [{lists}] AS lists FROM a9),
b2 AS (SELECT *, {e} AS e, count(*) OVER (PARTITION BY doc_id, block) AS n, lag(kind) {run} AS pk, lag(i) {run} IS NULL AS start, lead(i) {run} IS NULL AS ends FROM b1 WHERE kind <> 'blank' AND NOT dashes),
b3 AS (SELECT doc_id, i, CASE WHEN (kind IN ('table', 'item', 'more') AND NOT (nth = 1) AND kind <> 'more') OR kind = 'shut' OR coalesce(pk = 'open', false) OR start THEN '' ELSE chr(10) END || CASE kind
  WHEN 'head' THEN '<h' || length(regexp_extract(x, '^(#+)', 1)) || '>' || {_inline_sql(strip(r"regexp_replace(e, '^#{1,6}\s+', '')"))} || '</h' || length(regexp_extract(x, '^(#+)', 1)) || '>'
  WHEN 'rule' THEN '<hr>' WHEN 'quote' THEN {opened('blockquote', _inline_sql(r"regexp_replace(e, '^&gt;\s?', '')"))}
  WHEN 'table' THEN CASE WHEN nth = 1 THEN '<table>' ELSE '' END || CASE WHEN headed THEN {cells('th')} ELSE {cells('td')} END || CASE WHEN last OR headed AND n = 1 THEN '</table>' ELSE '' END
  WHEN 'item' THEN CASE WHEN depth > above THEN '<' || lists[depth] || '>' ELSE '' END || '<li>' || {_inline_sql(strip(r"regexp_replace(e, '^\s*([-*+]|\d+[.)])\s+', '')"))} || {shut}
  WHEN 'more' THEN {_inline_sql(strip('e'))} || {shut} WHEN 'open' THEN '<pre><code>' || CASE WHEN ends THEN '</code></pre>' ELSE '' END WHEN 'shut' THEN '</code></pre>'
  WHEN 'code' THEN e || CASE WHEN ends THEN '</code></pre>' ELSE '' END ELSE {opened('p', _inline_sql('e'))} END AS piece FROM b2),
t AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS x FROM ml GROUP BY doc_id),
u2 AS (SELECT doc_id, CASE WHEN regexp_extract(x, '(?m)^#\s+(.+)$', 1) <> '' THEN regexp_replace(regexp_extract(x, '(?m)^#\s+(.+)$', 1), '^\s+|\s+$', '', 'g') ELSE doc_id::VARCHAR END AS title FROM t)
SELECT t.doc_id, md5('<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>' || {e.replace("(x,", "(title,")} || '</title></head><body>' || chr(10) || coalesce(body, '') || chr(10) || '</body></html>' || chr(10)) AS html
FROM u2 t LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS body FROM b3 GROUP BY doc_id) USING (doc_id)"""


@query("render_html", _render_sql())
def render_html(spark: SparkSession, sf: str) -> DataFrame:
    return html.render(_markdown(spark, sf)).select("doc_id", F.md5("html").alias("html"))


# Every word of a menu becomes a picture, which exists if its length is even; a page has some several times.
@query("inline_images", r"""WITH h AS (SELECT page_id AS doc_id, regexp_replace(html, '<li><a href="/([^"]*)"', '<li><img alt="\1" src="\1"><a href="/\1"', 'g') AS h FROM pages),
s AS (SELECT doc_id, regexp_split_to_array(h, '<img[^>]+src="[^"]+"') AS b, regexp_extract_all(h, '<img[^>]+src="[^"]+"') AS t FROM h)
SELECT doc_id, md5(b[1] || array_to_string(list_transform(range(1, len(b)), lambda i: CASE WHEN length(regexp_extract(t[i], 'src="([^"]+)"', 1)) % 2 = 0
  THEN replace(t[i], regexp_extract(t[i], 'src="([^"]+)"', 1), 'data:image/png;base64,' || to_base64(encode(regexp_extract(t[i], 'src="([^"]+)"', 1)))) ELSE t[i] END || b[i + 1]), '')) AS html FROM s""")
def inline_images(spark: SparkSession, sf: str) -> DataFrame:
    made = F.regexp_replace("html", r'<li><a href="/([^"]*)"', r'<li><img alt="$1" src="$1"><a href="/$1"')
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), made.alias("html"))
    words = pages.select("doc_id", F.explode(F.regexp_extract_all("html", F.lit(html.IMG), F.lit(1))).alias("path")).where(F.length("path") % 2 == 0)
    images = words.select("doc_id", "path", F.lit(None).cast("string").alias("mime"), F.col("path").cast("binary").alias("content"))
    return html.embed_images(pages, images).select("doc_id", F.md5("html").alias("html"))


# The first two items of a menu nest, adverts are tables of two rows, and line breaks pictures.
TAGGED = r"""h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<nav><ul><li>(.*?)</li><li>(.*?)</li>', '<nav><ul><li>\1<ol><li>\2</li><li><p>x</p><p>y</p></li></ol></li>'),
 '<div class="ad">(.*?)</div>', '<table><tr><th>Ad</th><th>a|b</th></tr><tr><td><p>\1</p></td><td>2</td></tr></table>', 'g'), '<br>', '<img alt="a" src="x/p.jpeg">', 'g') AS h FROM pages)"""
LISTS, HEADS = "name IN ('ul', 'ol')", "name IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')"


def _to_markdown_sql() -> str:
    """The same states of the same tokens by SQL windows, for what the pages hold: lists of two levels, no quotations or code."""
    run = "OVER (PARTITION BY page_id ORDER BY pos)"
    block = ", ".join(f"'{t}'" for t in html.BLOCK_TAGS)
    held = lambda names: f"greatest(sum(CASE WHEN name IN ({names}) THEN CASE WHEN shut THEN -1 ELSE 1 END ELSE 0 END) {run}, 0)"
    latest = lambda when, value: f"last_value(CASE WHEN {when} THEN {value} END IGNORE NULLS) {run}"
    trim = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), ' *\n *', chr(10), 'g')"
    return rf"""WITH {TAGGED},
a1 AS (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT page_id, regexp_extract_all(regexp_replace(h, '(?is)<script(\s[^>]*)?>.*?</script\s*>|<style(\s[^>]*)?>.*?</style\s*>|<head(\s[^>]*)?>.*?</head\s*>|<title(\s[^>]*)?>.*?</title\s*>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '<[^>]+>|[^<]+') AS l FROM h)),
a2 AS (SELECT *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, starts_with(token, '</') AS shut FROM a1),
a3 AS (SELECT *, {held("'ul', 'ol'")} AS depth, {held("'table'")} AS tables, sum((name = 'img' AND NOT shut)::INT) {run} AS images, {latest("name = 'a' AND NOT shut", "regexp_extract(token, 'href=.([^\x22]*)', 1)")} AS href FROM a2),
a4 AS (SELECT *, {latest(f"{LISTS} AND NOT shut AND depth = 1", "pos")} AS l1, {latest(f"{LISTS} AND NOT shut AND depth = 2", "pos")} AS l2, {latest("name = 'li' AND NOT shut AND depth = 1", "pos")} AS i1, {latest("name = 'li' AND NOT shut AND depth = 2", "pos")} AS i2 FROM a3),
a5 AS (SELECT *, CASE depth WHEN 1 THEN l1 WHEN 2 THEN l2 END AS list, CASE depth WHEN 1 THEN i1 WHEN 2 THEN i2 END AS item FROM a4),
a6 AS (SELECT *, sum((name = 'li' AND NOT shut)::INT) OVER (PARTITION BY page_id, list ORDER BY pos) AS nth, sum(((name IN ({block}) AND tables = 0) OR (name = 'table' AND (shut OR tables = 1)))::INT + (name = 'hr')::INT) {run} AS block,
  CASE WHEN name = '' THEN regexp_replace({UNESCAPE.replace('{0}', 'token')}, '\s+', ' ', 'g') WHEN name IN ('b', 'strong') THEN '**' WHEN name = 'img' THEN '![a](images/fig_' || lpad(images::VARCHAR, 3, '0') || '.jpg)'
  WHEN name = 'a' AND href <> '' THEN CASE WHEN shut THEN '](' || href || ')' ELSE '[' END WHEN tables > 0 AND NOT shut AND name = 'tr' THEN chr(2) WHEN tables > 0 AND NOT shut AND name IN ('td', 'th') THEN chr(1) WHEN tables > 0 AND name IN ({block}) THEN ' ' ELSE '' END AS piece FROM a5),
b1 AS (SELECT page_id, block, string_agg(piece, '' ORDER BY pos) AS text, max(CASE WHEN {HEADS} AND NOT shut THEN name[2]::INT END) AS heading, arg_min(depth, pos) AS depth, first(list ORDER BY pos) AS list, first(item ORDER BY pos) AS item, arg_min(nth, pos) AS nth FROM a6 GROUP BY ALL),
b2 AS (SELECT *, list IN (SELECT pos FROM a2 WHERE a2.page_id = b1.page_id AND name = 'ol') AS ordered, row_number() OVER (PARTITION BY page_id, item ORDER BY block) = 1 AND item IS NOT NULL AS marked,
  CASE WHEN contains(text, chr(2)) THEN (SELECT string_agg('| ' || array_to_string(c, ' | ') || ' |' || CASE WHEN k = 0 THEN chr(10) || '| ' || array_to_string(list_transform(c, lambda v: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY k)
   FROM (SELECT unnest(range(len(r))) AS k, unnest(r) AS c FROM (SELECT list_filter(list_transform(string_split(text, chr(2)), lambda q: list_transform(string_split(q, chr(1))[2:], lambda v: replace(regexp_replace({trim('v')}, '\s+', ' ', 'g'), '|', '\|'))), lambda q: len(q) > 0) AS r))) ELSE {trim('text')} END AS body
  FROM b1 WHERE regexp_replace(text, '[\s*`\x01\x02]+', '', 'g') <> '')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS idx, md5(CASE WHEN depth > 0 THEN repeat('    ', depth::INT - marked::INT) ELSE '' END || CASE WHEN NOT marked THEN '' WHEN ordered THEN nth || '. ' ELSE '- ' END
 || CASE WHEN heading IS NOT NULL THEN repeat('#', heading) || ' ' ELSE '' END || replace(body, chr(10), chr(10) || repeat('    ', depth::INT))) AS text FROM b2"""


@query("html_markdown", _to_markdown_sql())
def html_markdown(spark: SparkSession, sf: str) -> DataFrame:
    nested = F.regexp_replace("html", "<nav><ul><li>(.*?)</li><li>(.*?)</li>", "<nav><ul><li>$1<ol><li>$2</li><li><p>x</p><p>y</p></li></ol></li>")
    tabled = F.regexp_replace(nested, '<div class="ad">(.*?)</div>', "<table><tr><th>Ad</th><th>a|b</th></tr><tr><td><p>$1</p></td><td>2</td></tr></table>")
    made = table(spark, sf, "pages").select("page_id", F.regexp_replace(tabled, "<br>", '<img alt="a" src="x/p.jpeg">').alias("html"))
    return html.to_markdown(made).select("page_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("text"))


# Jobs and relations --------------------------------------------------------------------------------------------------

JOBS = """jb AS (SELECT user_id AS stem, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS r, count(*) AS n FROM events GROUP BY user_id)"""


@query("job_status", f"""WITH {JOBS}, st AS (SELECT stem, n % 5 = 0 AS html, n % 3 > 0 AS running, n % 2 = 0 AS known, n % 7 > 0 AS source, n % 11 > 0 AS indexed, greatest(n, 1) AS k, a AS t, CASE WHEN n % 4 = 1 THEN c ELSE 0 END AS r, n % 13 = 0 AS g FROM jb)
SELECT stem, CASE WHEN html AND NOT running THEN 'done' WHEN running THEN 'running' WHEN known THEN 'failed' ELSE 'uploaded' END AS status,
(CASE WHEN html AND NOT running THEN 100 WHEN NOT running THEN 0 WHEN NOT source THEN 4 WHEN NOT indexed THEN 6 WHEN r > 0 THEN 70 + round_even(25 * r / k, 0) WHEN t >= k THEN 70 WHEN t > 0 OR g THEN 25 + round_even(45 * t / k, 0) ELSE 12 END)::INT AS pct FROM st""")
def job_status(spark: SparkSession, sf: str) -> DataFrame:
    kinds = lambda k: F.count_if(F.col("event_type") == k)
    jobs = table(spark, sf, "events").groupBy(F.col("user_id").alias("stem")).agg(kinds("view").alias("translated"), kinds("click").alias("c"), F.count("*").alias("n"))
    n = F.col("n")
    jobs = jobs.select("stem", (n % 5 == 0).alias("html"), (n % 3 > 0).alias("running"), (n % 2 == 0).alias("known"), (n % 7 > 0).alias("source"), (n % 11 > 0).alias("indexed"), n.alias("chunks"), "translated", F.when(n % 4 == 1, F.col("c")).otherwise(0).alias("reviewed"), (n % 13 == 0).alias("glossary"))
    return status.job_status(jobs).select("stem", "status", "pct")


@query("job_list_full_outer", "WITH i AS (SELECT c_custkey AS stem, c_name AS file FROM customer), o AS (SELECT DISTINCT o_custkey * 2 AS stem FROM orders) SELECT coalesce(i.stem, o.stem) AS stem, file FROM i FULL JOIN o ON i.stem = o.stem")
def job_list_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    inputs = table(spark, sf, "customer").select(F.col("c_custkey").alias("stem"), F.col("c_name").alias("file"), F.col("c_custkey").alias("mtime"))
    return status.job_list(inputs, table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("stem"))).select("stem", "file")


@query("stream_documents", f"WITH {U} SELECT doc_id, count(*) AS lines, sum({NORM_LEN.format('t')})::BIGINT AS chars FROM u GROUP BY doc_id")
def stream_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' files as a stream that ends with what is there; each batch is a table of whole documents."""
    import uuid

    from foliant.streaming import files

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def work(arrived: DataFrame) -> DataFrame:
        lines = paragraphs.explode_lines(arrived.select("doc_id", "text"))
        return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(T.norm_len(F.col("text"))).alias("chars"))

    stream = files.arriving(spark, f"{sf}/documents.parque[t]", "doc_id long, text string, lang string, source string, n_chars long")
    files.process(stream, work, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "lines", "chars")


@query("job_status_stream", f"""WITH {JOBS}, st AS (SELECT stem, n % 5 = 0 AS html, n % 3 > 0 AS running, n % 2 = 0 AS known, n % 7 > 0 AS source, n % 11 > 0 AS indexed, greatest(n, 1) AS k, a AS t, CASE WHEN n % 4 = 1 THEN c ELSE 0 END AS r, n % 13 = 0 AS g FROM jb),
v AS (SELECT stem, html AND NOT running AS done, running, known, source, indexed, r, t, k, g FROM st)
SELECT stem, CASE WHEN done THEN 'done' WHEN running THEN 'running' WHEN known THEN 'failed' ELSE 'uploaded' END AS status,
CASE WHEN done THEN 'complete' WHEN NOT running THEN CASE WHEN known THEN 'see the log' ELSE 'waiting' END WHEN NOT source THEN 'extracting' WHEN NOT indexed THEN 'splitting' WHEN r > 0 THEN 'reviewing (' || r || '/' || k || ')' WHEN t >= k THEN 'before review' WHEN t > 0 OR g THEN 'translating (' || t || '/' || k || ')' ELSE 'glossary' END AS phase,
(CASE WHEN done THEN 100 WHEN NOT running THEN 0 WHEN NOT source THEN 4 WHEN NOT indexed THEN 6 WHEN r > 0 THEN 70 + round_even(25 * r / k, 0) WHEN t >= k THEN 70 WHEN t > 0 OR g THEN 25 + round_even(45 * t / k, 0) ELSE 12 END)::INT AS pct FROM v""")
def job_status_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as files of a stream that is stopped halfway and started again; some events come twice."""
    import uuid

    from foliant.streaming import files
    from foliant.streaming import status as streamed

    at = f"{shared_dir(spark)}/status-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("stem"), F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("kind"))
    half = events.agg(F.expr("percentile_approx(unix_micros(time), 0.5)")).first()[0]
    early = F.unix_micros("time") <= half
    for part in (events.where(early), events.where(~early).unionByName(events.where(F.col("id") % 3 == 0))):
        part.coalesce(4).write.mode("append").parquet(f"{at}/in")
        arriving = files.arriving(spark, f"{at}/in", "id long, stem long, time timestamp, kind string")
        streamed.persist(streamed.job_counts(arriving, ["view", "click", "purchase"], late="60 days", idle_ms=365 * 24 * 3600 * 1000), f"{at}/out", f"{at}/state").awaitTermination()
    n = F.col("total")
    jobs = streamed.current(spark, f"{at}/out").select("stem", (n % 5 == 0).alias("html"), (n % 3 > 0).alias("running"), (n % 2 == 0).alias("known"), (n % 7 > 0).alias("source"), (n % 11 > 0).alias("indexed"), n.alias("chunks"), F.col("view").alias("translated"), F.when(n % 4 == 1, F.col("click")).otherwise(0).alias("reviewed"), (n % 13 == 0).alias("glossary"))
    return status.job_status(jobs).select("stem", "status", "phase", "pct")


@query("document_containers", f"""WITH {U}, v AS (SELECT doc_id, 'source' AS kind, '' AS name, CASE WHEN doc_id % 2 = 0 THEN 'new ' || text ELSE text END AS content FROM documents UNION ALL SELECT doc_id, 'line', idx::VARCHAR, t FROM u)
SELECT doc_id, kind, name, md5(content) AS content FROM v""")
def document_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and lines of all documents, committed; every second text is then replaced by a second commit."""
    import uuid

    from foliant.sources import containers

    at = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    texts = docs(spark, sf).select("doc_id", F.lit("source").alias("kind"), F.lit("").alias("name"), F.col("text").alias("content"))
    lines = lines_of(spark, sf).select("doc_id", F.lit("line").alias("kind"), F.col("idx").cast("string").alias("name"), F.col("text").alias("content"))
    containers.write_documents(texts.unionByName(lines), at)
    containers.write_documents(texts.where(F.col("doc_id") % 2 == 0).withColumn("content", F.concat(F.lit("new "), F.col("content"))), at)
    return containers.read_documents(spark, at).withColumn("content", F.md5("content"))


# Relations that the operators rest on, over the order tables ----------------------------------------------------------


@query("orders_without_lines_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def orders_without_lines_anti(spark: SparkSession, sf: str) -> DataFrame:
    large = table(spark, sf, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(large, "o_orderkey", "left_anti")


@query("customers_with_orders_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def customers_with_orders_semi(spark: SparkSession, sf: str) -> DataFrame:
    large = table(spark, sf, "orders").where(F.col("o_totalprice") > 100000).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query("event_before_asof", "SELECT event_id, coalesce(max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS click FROM events")
def event_before_asof(spark: SparkSession, sf: str) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "events").select("event_id", F.coalesce(F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(before), F.lit(-1)).alias("click"))


@query("top_orders_by_customer", "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_orders_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    ranked = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("n"))
    return ranked.where(F.col("n") <= 3)


@query("nations_except", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def nations_except(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").where(F.col("s_acctbal") < 0)
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).subtract(suppliers.select("s_nationkey"))
