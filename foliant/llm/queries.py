"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table
from foliant.llm.conversation_repair import repair
from foliant.llm.minhash import near_duplicates
from foliant.llm.mixing import mix
from foliant.llm.nearest import build_index, nearest
from foliant.llm.packing import pack
from foliant.llm.periodic import looped, periodic_runs
from foliant.llm.repeats import repeated_passages
from foliant.llm.secret_scan import labelled_findings, scan
from foliant.llm.secret_scan import train as train_forest
from foliant.llm.sharding import shard
from foliant.llm.site_text import main_text
from foliant.llm.token_files import read_token_files, write_token_files
from foliant.llm.tokens import vocabulary
from foliant.llm.toxicity import held_out, score, train
from foliant.llm.vector_dedup import near_vectors

SHARDS = 40
#: Scores from which a document counts as toxic.
TOXIC = 0.7


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '~')), 1, 13) AS k
  FROM documents),
goals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM goals),
ran AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM weighed),
level AS (
  SELECT arg_min((total - caps) / rest, cap / w) FILTER ((total - caps) / rest < cap / w) AS lam FROM ran),
targets AS (
  SELECT source, source_size, CASE WHEN lam IS NULL THEN cap ELSE least(cap, lam * w) END AS target FROM weighed, level),
before AS (
  SELECT s.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE
    floor(target)::BIGINT // source_size * size
    + greatest(0, least(size, floor(target)::BIGINT % source_size - b)) END)::BIGINT AS taken
FROM before
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), train_forest(labelled_findings(spark)))
    return found.select("doc_id", "place", "nth", F.length("candidate").alias("length"), F.crc32(F.col("candidate").cast("binary")).alias("candidate_crc32"), "score", "is_secret")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=1))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op5_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2, capacity=1024).drop("ids")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=80)


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(build_index(vectors, depth=20), vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), least=50)


def op10_shard_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs, exponent=4, length=6)
    longer = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(longer(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit(" ")).alias("text"))
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k != 0).alias("present"), F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    found = repair(rows, present="present")
    return found.withColumn("repaired_sha256", F.sha2(F.array_join(line, "\n"), 256)).drop("turns")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


REACHED = """reached(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)"""

OP4_SQL = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges AS (SELECT x.id AS a, y.id AS b FROM sound x JOIN sound y ON x.label = y.label AND len(x.e) = len(y.e) AND x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
nodes AS (SELECT DISTINCT a AS id FROM edges),
{REACHED}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN least ON least.id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM edges GROUP BY a) ON a = vec_id
"""

OP6_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT id, array_to_string(w[k : k + 3], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 2))) AS k FROM split WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
edges AS (SELECT a, b FROM pairs JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
nodes AS (SELECT DISTINCT a AS id FROM edges),
{REACHED}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) IS NOT DISTINCT FROM doc_id AS kept
FROM documents LEFT JOIN sizes ON sizes.id = doc_id LEFT JOIN least ON least.id = doc_id
"""

OP10_SQL = f"""
WITH bits AS (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
scored AS (
  SELECT doc_id, arg_max(s, h) FILTER (s < {SHARDS}) AS shard, arg_max(s, h) AS grown_shard
  FROM (SELECT doc_id, s, substr(md5('shard:' || coalesce(doc_id::VARCHAR, '~') || ':' || s), 1, 13) AS h FROM (SELECT DISTINCT doc_id FROM documents), range({SHARDS + 1}) r(s)) GROUP BY doc_id),
found AS (
  SELECT b.doc_id, len(b)::BIGINT + 16 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32, shard, grown_shard
  FROM bytes b, crcs, scored s WHERE s.doc_id IS NOT DISTINCT FROM b.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5('slot:' || coalesce(doc_id::VARCHAR, '~')), 1, 13), doc_id, text_crc32) - 1 AS slot
FROM found
"""

CRC_SQL = """bits AS (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits)"""

#: Of the four states before a turn: their least cost and audit, from those after it.
OP12_WAY = """{{c: {w}[{k}].c + {cost}, a: '{letter}' || {w}[{k}].a}}"""


def _op12_sql() -> str:
    """A turn at a time from the last one: for each state (nothing, system, user, assistant said) the least (cost, audit)."""
    after = (3, 3, 4, 3)  # the state, from 1, after a turn inserted or reroled
    kept = ({"s": 2, "u": 3}, {"u": 3}, {"a": 4}, {"u": 3})
    way = lambda w, k, cost, letter: OP12_WAY.format(w=w, k=k, cost=cost, letter=letter)
    base = []
    for k in range(4):
        keep = " ".join(f"WHEN '{x}' THEN {way('w', to, 'cut', 'K')}" for x, to in kept[k].items())
        base.append(f"list_min([{way('w', k + 1, 3, 'D')}] || CASE WHEN must THEN [] ELSE [{way('w', after[k], '2 + cut', 'R')}] END || CASE WHEN must THEN [] ELSE list_filter([CASE i {keep} END], lambda x: x IS NOT NULL) END)")
    least = lambda w, k, then: f"list_min([{w}[{k}], {then}])"
    once = f"[b[1], b[2], {least('b', 3, way('b', 4, 2, 'I'))}, {least('b', 4, way('b', 3, 2, 'I'))}]"
    full = f"[{least('o', 1, way('o', 3, 2, 'I'))}, {least('o', 2, way('o', 3, 2, 'I'))}, o[3], o[4]]"
    return rf"""
WITH RECURSIVE {CRC_SQL},
damaged AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, crcs),
rows AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM damaged, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, substr(role, 1, 1) AS i,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open
  FROM ordered),
marked AS (
  SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND open AS truncated, blank OR again AS must, (NOT blank AND NOT again AND open)::INT AS cut,
    n > 1 AND lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
steps AS (
  SELECT conv_id, max(n) AS n, [{{c: 0, a: ''}}, {{c: 4, a: 'II'}}, {{c: 2, a: 'I'}}, {{c: 0, a: ''}}] AS w FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n - 1, {full} FROM (
    SELECT conv_id, n, {once} AS o FROM (
      SELECT s.conv_id, s.n, [{", ".join(base)}] AS b
      FROM steps s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.n))),
ways AS (SELECT conv_id, w[1].c AS cost, w[1].a AS audit FROM steps WHERE n = 0),
edits AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS x, generate_subscripts(string_split(audit, ''), 1) AS e FROM ways WHERE audit <> ''),
ran AS (SELECT *, sum((x <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY e) AS n FROM edits),
kept AS (
  SELECT r.conv_id, e, x, m.role, CASE x WHEN 'I' THEN '' ELSE m.text END AS text FROM ran r LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.n = r.n WHERE x <> 'D'),
spoken AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY e) - bool_or(x = 'K' AND role[1] = 's') OVER (PARTITION BY conv_id)::INT AS place FROM kept),
told AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY e)) AS h FROM spoken GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank, sum(duplicate::INT)::BIGINT AS duplicate,
    sum(truncated::INT)::BIGINT AS truncated, sum(illegal::INT)::BIGINT AS illegal FROM marked GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_files": op3_token_files,
    "op4_near_vectors": op4_near_vectors,
    "op5_pack_best_fit": op5_pack_best_fit,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_nearest_vectors": op7_nearest_vectors,
    "op8_toxicity_ftrl": op8_toxicity_ftrl,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_shard_rendezvous": op10_shard_rendezvous,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_repair_conversations": op12_repair_conversations,
    "op13_main_text": op13_main_text,
}

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op4_near_vectors": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op10_shard_rendezvous": OP10_SQL, "op12_repair_conversations": _op12_sql()}
