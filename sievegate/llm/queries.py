"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.decontamination import mark_benchmark
from sievegate.llm.language import identify, reject, rejection_limits, train, training_rows
from sievegate.llm.licenses import scan_licenses
from sievegate.llm.lines import mark_lines
from sievegate.llm.mixing import in_training_order, mix_documents, rank_readings
from sievegate.llm.quality import judge_quality
from sievegate.llm.secrets import scan_secrets
from sievegate.llm.sharding import shard_documents
from sievegate.llm.similar import near_duplicates
from sievegate.llm.toxicity import fit, held_out, score_toxicity
from sievegate.llm.tries import conversation_trie
from sievegate.llm.urls import judge_urls
from sievegate.llm.variants import group_variants, vocabulary
from sievegate.sources.tables import rows_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SHARDS = 24

# The rules of the URL query.
URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in SQL."""
    step = "xor(s >> 1, (s & 1) * 3988292384)"
    byte = f"list_reduce([xor(a, b)] || [0::BIGINT for i in range(8)], lambda s, n: {step})"
    codes = f"[ord(c)::BIGINT for c in string_split({text}, '')]"
    return f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || {codes}, lambda a, b: {byte}))"


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def texts(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *more, "text")


@register("op1_jump_sharding")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_documents(texts(spark, folder), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


@register("op2_license_index")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(texts(spark, folder)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@register("op3_url_sweep", f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f USING (page_id)""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rules = rows_table(spark, "verdict string, host string, path string", URL_RULES)
    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


@register("op5_weak_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(texts(spark, folder), drop=("text",)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "quality")


@register("op7_suffix_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mark_benchmark(texts(spark, folder), table(spark, folder, "benchmark"), drop=("text",)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(texts(spark, folder), drop=("text",)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@register("op9_curriculum_mix", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
keyed AS (SELECT *, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', CAST(size AS VARCHAR))) AS k FROM sized),
totals AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, 2.0::DOUBLE * source_size AS cap FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN size > 0 THEN size * greatest(0, floor((target - start - size / 2) / source_size) + 1)
    ELSE 0 END AS BIGINT) AS taken
FROM placed""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_documents(texts(spark, folder, "source"), drop=("text",))
    return in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken")


@register("op9_curriculum_order", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
keyed AS (SELECT *, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', CAST(size AS VARCHAR))) AS k FROM sized),
totals AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, 2.0::DOUBLE * source_size AS cap FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target,
  [-0.6, 0.0, 0.6][1 + (rk - 1) % 3]::DOUBLE AS slope FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM keyed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
readings AS (
  SELECT p.doc_id, p.slope, r.reading, ((r.reading - 1) * p.source_size + p.middle) / p.target AS part
  FROM placed p, range(1, 4) r(reading)
  WHERE p.size > 0 AND (r.reading - 1) * p.source_size + p.middle <= p.target),
timed AS (
  SELECT doc_id, reading,
    2 * part / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part)) AS position FROM readings)
SELECT doc_id, CAST(reading AS INT) AS reading, position,
  row_number() OVER (ORDER BY position, doc_id ASC NULLS FIRST) AS rank
FROM timed""")
def op9_order(spark: SparkSession, folder: str) -> DataFrame:
    return rank_readings(mix_documents(texts(spark, folder, "source"), drop=("text",)), ["doc_id"])


@register("op10_kneser_ney_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "lang")
    teaching = training_rows("doc_id", 4, 2)
    # Scored once: the limits come from the scores of all teaching documents.
    scored = identify(docs, train(docs.where(teaching)), drop=("text",)).checkpoint()
    return reject(scored, rejection_limits(scored.where(teaching))).select(
        "doc_id", (~teaching).alias("held_out"), "lang_pred", "score", "rejected")


@register("op4_compression_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder)
    return score_toxicity(docs, fit(docs, table(spark, folder, "labels")), drop=("text",)).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted")


@register("op6_chosen_path_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(texts(spark, folder)).select(
        "doc_id", "class_id", "n_links", "rep_id", "copies", "n_texts")


@register("op12_line_dedup", r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM cut),
firsts AS (SELECT k, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (
  SELECT c.doc_id, c.line, c.place, coalesce(f.n >= 2 AND c.doc_id <> f.first, false) AS gone
  FROM keyed c LEFT JOIN firsts f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return mark_lines(texts(spark, folder), drop=("text",)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@register("op13_conversation_trie", rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base
  FROM (SELECT DISTINCT conv_id FROM turns)),
pieces AS (
  SELECT i.conv_id, 0 AS part, t.p, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.p < i.h
  UNION ALL
  SELECT i.conv_id, 1, t.p, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.p >= i.h),
placed AS (
  SELECT conv_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER w AS depth, md5(string_agg(md5(role || chr(1) || md5(text)), '') OVER w) AS node
  FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY part, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (
  SELECT conv_id, depth, node, words, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
    depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM placed
  UNION ALL
  SELECT conv_id, 0, '', 0, NULL, conv_id NOT IN (SELECT conv_id FROM placed) FROM ids),
nodes AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs,
    (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM steps GROUP BY node),
families AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN families f USING (node)),
reach AS (
  SELECT DISTINCT a.node, b.node AS under FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT r.node, sum(u.saved) AS saved_tokens, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves
  FROM reach r JOIN full_nodes u ON u.node = r.under GROUP BY r.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON n.parent = p.node""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


@register("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return group_variants(vocabulary(texts(spark, folder))).select("word", "form", "root", "n", "n_near", "form_n")
