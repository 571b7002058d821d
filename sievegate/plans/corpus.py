"""Corpus preparation queries: text clean-up, sections, chunks, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import text as tx
from sievegate.operators import chunking as ch
from sievegate.plans import fixtures as fx
from sievegate.plans.fixtures import quote, sql
from sievegate.plans.registry import ORACLE, register
from sievegate.sources.tables import table, text_table

NL = "chr(10)"
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


# ---- SQL forms of the text rules -------------------------------------------------

def sql_normalize(t: str) -> str:
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace({t}, '(\\w)-\\n(\\w)', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '(?m)^[ \\t]*[-\u2022\u00b7\u2219][ \\t]+|^[ \\t]*\\*[ \\t]+', '', 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda x: trim(x, {BLANKS})), chr(10))"
    return f"trim(regexp_replace({t}, '\\n{{2,}}', chr(10) || chr(10), 'g'), {BLANKS})"


def sql_light(t: str) -> str:
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({t}, {BLANKS})"


def sql_html(t: str) -> str:
    t = f"regexp_replace(regexp_replace({t}, '<style[^>]*>.*?</style>', '', 'gsi'), '<script[^>]*>.*?</script>', '', 'gsi')"
    t = f"regexp_replace(regexp_replace({t}, '<!--.*?-->', '', 'gs'), '<[^>]+>', ' ', 'g')"
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")]:
        t = f"replace({t}, '{entity}', '{char}')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({t}, {BLANKS})"


def sql_words(t: str) -> str:
    return f"list_filter(regexp_split_to_array(trim({t}, {BLANKS}), '\\s+'), lambda x: x <> '')"


def sql_tokens(t: str) -> str:
    return f"list_filter({sql_words(f'lower({t})')}, lambda x: length(x) > 1)"


def sql_sentences(t: str) -> str:
    marked = f"regexp_replace(trim({t}, {BLANKS}), '([.!?。！？])\\s+', '\\1' || chr(1), 'g')"
    parts = f"regexp_split_to_array({marked}, '\\x01|\\n+')"
    return (f"list_filter(list_transform({parts}, lambda x: trim(x, {BLANKS})), lambda x: x <> '')")


def sql_heading(line: str, strict: bool = False) -> str:
    caps = fixed.HEADING_CAPITALS
    named = (r"^\s*(?:chương|phần|mục|section|chapter)\s+[\dIVXivx]+[\.:]\s*.+"
             r"|^\s*(?:Điều|điều)\s+\d+[\.\:]\s*.+")
    capital = rf"^\s*\d+[\.\)]\s+[{caps}].{{3,80}}$|^\s*[{caps}]{{4,}}(?:\s+[{caps}]+)*\s*$"
    closing = "(?:" + "|".join(fixed.HEADING_NOT_ENDING) + ")$"
    line = f"trim({line}, {BLANKS})"
    bare = f"regexp_replace({line}, '^\\*{{1,3}}(.*?)\\*{{1,3}}$', '\\1')"
    flag = "" if strict else ", 'i'"
    return (f"({line} <> '' AND length({line}) <= 120 AND NOT regexp_matches({line}, {quote(fixed.PAGE_HEADER_WORDS)}, 'i')"
            f" AND NOT regexp_matches({bare}, {quote(closing)})"
            f" AND (regexp_matches({bare}, {quote(named)}, 'i') OR regexp_matches({bare}, {quote(capital)}{flag})))")


# ---- clean-up -----------------------------------------------------------------------

@register("text_normalize", f"SELECT doc_id, sha256(t) text_hash, length(t) n FROM (SELECT doc_id, {sql_normalize('text')} t FROM documents)")
def text_normalize(spark, sf):
    out = text_table(spark, sf, "documents").select("doc_id", tx.normalize_text("text").alias("t"))
    return out.select("doc_id", F.sha2("t", 256).alias("text_hash"), F.length("t").alias("n"))


@register("text_normalize_light", f"SELECT page_id, sha256(t) text_hash FROM (SELECT page_id, {sql_light('html')} t FROM pages)")
def text_normalize_light(spark, sf):
    return text_table(spark, sf, "pages").select(
        "page_id", F.sha2(tx.normalize_light("html"), 256).alias("text_hash"))


@register("html_to_text", f"SELECT page_id, sha256(t) text_hash, length(t) n FROM (SELECT page_id, {sql_html('html')} t FROM pages)")
def html_to_text(spark, sf):
    out = text_table(spark, sf, "pages").select("page_id", tx.html_to_text("html").alias("t"))
    return out.select("page_id", F.sha2("t", 256).alias("text_hash"), F.length("t").alias("n"))


@register("content_hash", "SELECT doc_id, sha256(text) checksum, octet_length(encode(text)) size_bytes FROM documents")
def content_hash(spark, sf):
    return text_table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").alias("size_bytes"))


@register("token_counts", f"""SELECT doc_id, len({sql_words('text')}) word_count,
  CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END estimated FROM documents""")
def token_counts(spark, sf):
    return text_table(spark, sf, "documents").select(
        "doc_id", tx.word_count("text").alias("word_count"), tx.estimated_tokens("text").alias("estimated"))


@register("accent_strip_tokens", f"""SELECT doc_id, len(list_distinct(t)) distinct_plain, sha256(array_to_string(t, ' ')) plain_hash
  FROM (SELECT doc_id, list_transform({sql_tokens('text')}, lambda x: strip_accents(replace(x, 'đ', 'd'))) t FROM documents)""")
def accent_strip_tokens(spark, sf):
    tokens = text_table(spark, sf, "documents").select(
        "doc_id", F.transform(tx.search_tokens("text"), tx.strip_accents).alias("t"))
    return tokens.select("doc_id", F.size(F.array_distinct("t")).alias("distinct_plain"),
                         F.sha2(F.array_join("t", " "), 256).alias("plain_hash"))


@register("repeated_page_lines", sql("doc_pages", f"""
WITH l AS (SELECT doc_id, page_no, list_filter(list_transform(string_split(text, {NL}), lambda x: trim(x, {BLANKS})), lambda x: x <> '') f FROM doc_pages),
e AS (SELECT doc_id, 't' side, unnest(f[1:3]) line FROM l UNION ALL
      SELECT doc_id, 'b', unnest(f[greatest(1, len(f) - 2):]) FROM l),
noise AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, side, line FROM e WHERE length(line) > 5 GROUP BY ALL HAVING count(*) >= 3)
   WHERE doc_id IN (SELECT doc_id FROM doc_pages GROUP BY 1 HAVING count(*) >= 2)),
n AS (SELECT doc_id, list(line) ns FROM noise GROUP BY 1)
SELECT p.doc_id, page_no, sha256(CASE WHEN ns IS NULL THEN text ELSE
   trim(array_to_string(list_filter(string_split(text, {NL}), lambda x: NOT list_contains(ns, trim(x, {BLANKS}))), {NL}), {BLANKS}) END) text_hash
FROM doc_pages p LEFT JOIN n ON p.doc_id = n.doc_id"""))
def repeated_page_lines(spark, sf):
    return ch.strip_repeated_page_lines(fx.pages(spark, sf)).select(
        "doc_id", "page_no", F.sha2("text", 256).alias("text_hash"))


@register("page_header_lines", sql("doc_pages", f"""SELECT doc_id, page_no,
  sha256(regexp_replace(text, {quote('(?im)' + fixed.PAGE_HEADER_LINE)}, '', 'g')) text_hash FROM doc_pages"""))
def page_header_lines(spark, sf):
    return fx.pages(spark, sf).select(
        "doc_id", "page_no", F.sha2(tx.strip_page_header_lines("text"), 256).alias("text_hash"))


@register("noise_lines", sql("annotated", f"""
WITH w AS (SELECT doc_id, list_transform(string_split(text, {NL}), lambda line: list_filter(
     list_transform({sql_words('line')}, lambda x: regexp_replace(x, '^[^\\pL\\pN_]+|[^\\pL\\pN_]+$', '', 'g')),
     lambda x: length(x) >= 2 AND length(regexp_replace(x, '[^\\pL]', '', 'g')) >= 2
       AND length(regexp_replace(x, '[^\\pL]', '', 'g')) / length(x) >= 0.5)) ls FROM annotated)
SELECT doc_id, sha256(array_to_string(list_transform(list_filter(ls, lambda x: len(x) >= 2), lambda x: array_to_string(x, ' ')), {NL})) text_hash FROM w"""))
def noise_lines(spark, sf):
    return fx.annotated(spark, sf).select("doc_id", F.sha2(tx.clean_noise("text"), 256).alias("text_hash"))


@register("flow_labels", f"""
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, {BLANKS})), lambda x: x <> '') ls FROM conversations),
c AS (SELECT *, list_transform(ls, lambda x: len({sql_words('x')})) k FROM l)
SELECT conv_id, turn, sha256(CASE WHEN len(ls) >= 3 AND list_sum(k) / len(ls) <= 5 AND list_max(k) <= greatest(list_sum(k) / len(ls) * 2, 6)
  THEN array_to_string(ls, ' → ') ELSE array_to_string(ls, {NL}) END) text_hash FROM c""")
def flow_labels(spark, sf):
    lines = F.filter(F.transform(F.split("text", r"\."), tx.strip), lambda x: x != "")
    return table(spark, sf, "conversations").withColumn("ls", lines).select(
        "conv_id", "turn", F.sha2(tx.join_as_flow(F.col("ls")), 256).alias("text_hash"))


# ---- sections, sentences, chunks --------------------------------------------------------

def heading_text(spark, sf, *more):
    """Documents with numbered headings put before every sixth line."""
    docs = text_table(spark, sf, "documents").withColumn("ls", F.split("text", "\n"))
    return docs.select("doc_id", *more, F.array_join(F.transform(
        "ls", lambda x, i: F.when(i % 6 == 3, F.concat(F.lit("Section "), (i / 6).cast("int"), F.lit(". Topic "), F.col("doc_id") % 9, F.lit("\n"), x))
        .when(i % 11 == 7, F.concat(F.lit("TRÌNH CHUNG\n"), x)).otherwise(x)), "\n").alias("text"))


def paged_text(spark, sf):
    """The same with the document's pages, as `fixtures.pages` cuts them, on its row."""
    return heading_text(spark, sf, F.expr(f"""transform(sequence(0, cast((size(ls) - 1) div {fx.PAGE_LINES} as int)), p -> struct(
        cast(p + 1 as int) AS page_no, concat('Running head ', doc_id % 3, '\\n', array_join(slice(ls, p * {fx.PAGE_LINES} + 1, {fx.PAGE_LINES}), '\\n'),
        '\\n  Lần ban hành 01\\nPage ', p + 1) AS text))""").alias("pages"))


fx.CTE["heading_text"] = ([], f"""SELECT doc_id, array_to_string(list_transform(string_split(text, {NL}),
   lambda x, i: CASE WHEN (i - 1) % 6 = 3 THEN 'Section ' || ((i - 1) // 6) || '. Topic ' || (doc_id % 9) || {NL} || x
     WHEN (i - 1) % 11 = 7 THEN 'TRÌNH CHUNG' || {NL} || x ELSE x END), {NL}) AS text FROM documents""")

fx.CTE["doc_lines"] = (["heading_text"], f"""SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) i FROM (
   SELECT doc_id, string_split(trim(text, {BLANKS}), {NL}) ls FROM heading_text)""")
fx.CTE["doc_heads"] = (["doc_lines"], f"SELECT doc_id, i, line, {sql_heading('line')} h FROM doc_lines")
fx.CTE["raw_sections"] = (["doc_heads"], f"""SELECT doc_id, g, max(CASE WHEN h THEN trim(line, {BLANKS}) END) heading,
   trim(string_agg(CASE WHEN NOT h THEN line END, {NL} ORDER BY i), {BLANKS}) body
   FROM (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) g FROM doc_heads) GROUP BY doc_id, g""")
fx.CTE["doc_sections"] = (["raw_sections"], """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 section_index,
   coalesce(heading, '') heading, body FROM raw_sections WHERE coalesce(body, '') <> ''""")


@register("heading_lines", sql("doc_lines", f"""SELECT doc_id, count_if({sql_heading('line')}) compat_headings,
  count_if({sql_heading('line', True)}) strict_headings FROM doc_lines GROUP BY doc_id"""))
def heading_lines(spark, sf):
    lines = heading_text(spark, sf).withColumn("ls", F.split(tx.strip("text"), "\n"))
    return lines.select(
        "doc_id",
        F.size(F.filter("ls", lambda x: tx.is_heading(x, "compat"))).cast("long").alias("compat_headings"),
        F.size(F.filter("ls", lambda x: tx.is_heading(x, "strict"))).cast("long").alias("strict_headings"))


@register("document_sections", sql("doc_sections", "SELECT doc_id, section_index, heading, sha256(body) body_hash FROM doc_sections"))
def document_sections(spark, sf):
    return ch.sections(heading_text(spark, sf)).select(
        "doc_id", "section_index", "heading", F.sha2("body", 256).alias("body_hash"))


@register("sentence_split", f"""SELECT doc_id, len(s) n, sha256(array_to_string(s, '|')) joined_hash
  FROM (SELECT doc_id, {sql_sentences('text')} s FROM documents)""")
def sentence_split(spark, sf):
    out = text_table(spark, sf, "documents").select("doc_id", tx.sentences("text").alias("s"))
    return out.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("joined_hash"))


@register("word_windows", f"""
WITH w AS (SELECT doc_id, {sql_words('text')} ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(0, 1 + greatest(0, ceil((len(ws) - 64) / 56.0)::BIGINT))) k FROM w WHERE len(ws) > 0)
SELECT doc_id, k piece_no, sha256(array_to_string(ws[k * 56 + 1 : k * 56 + 64], ' ')) piece_hash FROM i""")
def word_windows(spark, sf):
    out = text_table(spark, sf, "documents").select("doc_id", F.posexplode(tx.hard_split(F.col("text"), 64, 8)))
    return out.select("doc_id", F.col("pos").alias("piece_no"), F.sha2("col", 256).alias("piece_hash"))


PACK = ch.ChunkSettings(max_tokens=60, overlap_tokens=12, min_tokens=10)

# The packing loop, one sentence per step and section.
fx.CTE["section_sentences"] = (["doc_sections"], f"""SELECT doc_id, section_index, {sql_sentences('body')} ss FROM doc_sections""")
fx.CTE["counted"] = (["section_sentences"], f"""SELECT doc_id, section_index, ss,
    list_transform(ss, lambda x: len({sql_words('x')})) cs FROM section_sentences""")
fx.CTE["pack_steps"] = (["counted"], """
  SELECT doc_id, section_index, 0 i, 1 st, 0 used, []::INT[] out_f, []::INT[] out_l FROM counted
  UNION ALL
  SELECT p.doc_id, p.section_index, p.i + 1,
    CASE WHEN c > 60 THEN p.i + 2
         WHEN st <= p.i AND used + c > 60 THEN p.i + 1 - tail
         ELSE st END,
    CASE WHEN c > 60 THEN 0
         WHEN st <= p.i AND used + c > 60 THEN coalesce(list_sum(cs[p.i + 1 - tail : p.i]), 0) * (tail > 0)::INT + c
         ELSE used + c END::INT,
    CASE WHEN c > 60 AND st <= p.i THEN out_f || [st, p.i + 1] WHEN c > 60 THEN out_f || [p.i + 1]
         WHEN st <= p.i AND used + c > 60 THEN out_f || [st] ELSE out_f END,
    CASE WHEN c > 60 AND st <= p.i THEN out_l || [p.i, 0] WHEN c > 60 THEN out_l || [0]
         WHEN st <= p.i AND used + c > 60 THEN out_l || [p.i] ELSE out_l END
  FROM (SELECT q.*, cs, cs[q.i + 1] c,
          len(list_filter(range(st, q.i + 1), lambda j: list_sum(cs[j : q.i]) <= 12)) tail
        FROM pack_steps q JOIN counted USING (doc_id, section_index) WHERE q.i < len(cs)) p""")
fx.CTE["packed"] = (["pack_steps", "counted"], """SELECT doc_id, section_index, ss,
    CASE WHEN st <= len(cs) THEN out_f || [st] ELSE out_f END ff, CASE WHEN st <= len(cs) THEN out_l || [len(cs)::INT] ELSE out_l END ll
  FROM pack_steps p JOIN counted USING (doc_id, section_index) WHERE p.i = len(cs)""")
fx.CTE["pieces"] = (["packed"], f"""SELECT doc_id, section_index, pos, k, text, len({sql_words('text')}) tokens FROM (
   SELECT doc_id, section_index, pos, 0 k, array_to_string(ss[f:l], ' ') AS text FROM spans WHERE l > 0
   UNION ALL SELECT doc_id, section_index, pos, k, array_to_string(ws[k * 48 + 1 : k * 48 + 60], ' ') FROM (
     SELECT *, unnest(range(0, 1 + greatest(0, ceil((len(ws) - 60) / 48.0)::BIGINT))) k
     FROM (SELECT *, {sql_words('ss[f]')} ws FROM spans WHERE l = 0)))""")
fx.CTE["spans"] = (["packed"], """SELECT doc_id, section_index, ss, unnest(ff) f, unnest(ll) l, generate_subscripts(ff, 1) pos FROM packed""")
fx.CTE["pieces"] = (["spans"], fx.CTE["pieces"][1])
fx.CTE["grouped_pieces"] = (["pieces"], """SELECT *, sum((tokens >= 10 OR o = 1)::INT) OVER (PARTITION BY doc_id ORDER BY o) g FROM (
   SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, pos, k) o,
     row_number() OVER (PARTITION BY doc_id, section_index ORDER BY pos, k) - 1 loc FROM pieces)""")
fx.CTE["packed_chunks"] = (["grouped_pieces", "doc_sections"], f"""SELECT g.doc_id, (g - 1)::INT chunk_index,
    string_agg(g.text, {NL} || {NL} ORDER BY o) chunk_text, sum(tokens)::INT token_count,
    sha256(arg_min(g.text, o)) chunk_hash, arg_min(g.section_index, o) section_index, arg_min(loc, o) local_chunk_index
  FROM grouped_pieces g GROUP BY g.doc_id, g""")


@register("packed_chunks", sql("packed_chunks", f"""
SELECT p.doc_id, chunk_index, sha256(CASE WHEN heading <> '' THEN heading || {NL} || {NL} || chunk_text ELSE chunk_text END) embed_hash,
  token_count, chunk_hash, p.section_index, p.local_chunk_index, heading section_heading,
  round_even(p.section_index / n, 4) position_ratio
FROM packed_chunks p JOIN doc_sections s ON p.doc_id = s.doc_id AND p.section_index = s.section_index
JOIN (SELECT doc_id, count(*) n FROM doc_sections GROUP BY 1) t ON t.doc_id = p.doc_id"""))
def packed_chunks(spark, sf):
    return ch.chunk_documents(heading_text(spark, sf), PACK).select(
        "doc_id", "chunk_index", F.sha2("embed_text", 256).alias("embed_hash"), "token_count", "chunk_hash",
        "section_index", "local_chunk_index", "section_heading", "position_ratio")


@register("chunk_pages", sql("packed_chunks doc_pages", f"""
WITH p AS (SELECT doc_id, page_no, trim(text, {BLANKS}) t FROM doc_pages),
o AS (SELECT doc_id, page_no, t, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ps FROM p WHERE t <> ''),
j AS (SELECT doc_id, string_agg(t, {NL} || {NL} ORDER BY page_no) || {NL} || {NL} s FROM o GROUP BY 1),
c AS (SELECT c.doc_id, chunk_index, chunk_text, s,
   (list_filter(list_transform(string_split(chunk_text, {NL}), lambda x: trim(x, {BLANKS})), lambda x: length(x) > 15))[1][1:80] p1,
   trim(chunk_text[1:80], {BLANKS}) p2 FROM packed_chunks c LEFT JOIN j ON c.doc_id = j.doc_id),
f AS (SELECT *, CASE WHEN length(p1) > 10 AND instr(s, p1) > 0 THEN instr(s, p1) - 1
     WHEN length(p2) > 10 AND instr(s, p2) > 0 THEN instr(s, p2) - 1 END pos FROM c)
SELECT f.doc_id, f.chunk_index, coalesce(min(o.page_no), 1)::INT page_start, coalesce(max(o.page_no), any_value(tot))::INT page_end
FROM f LEFT JOIN (SELECT doc_id, count(*) tot FROM doc_pages GROUP BY 1) t ON t.doc_id = f.doc_id
LEFT JOIN o ON o.doc_id = f.doc_id AND pos < ps + length(t) + 2 AND pos + length(chunk_text) > ps
GROUP BY f.doc_id, f.chunk_index"""))
def chunk_pages(spark, sf):
    """Pages stand on the document's row, as one file's; no text moves."""
    return ch.chunk_documents(paged_text(spark, sf), PACK, pages_col="pages").select(
        "doc_id", "chunk_index", "page_start", "page_end")


@register("chunk_pages_of_table", ORACLE["chunk_pages"])
def chunk_pages_of_table(spark, sf):
    """The same from a table of pages."""
    chunks = ch.chunk_documents(heading_text(spark, sf), PACK).select("doc_id", "chunk_index", "chunk_text")
    return ch.locate_pages(chunks, fx.pages(spark, sf)).select("doc_id", "chunk_index", "page_start", "page_end")


fx.CTE["raw_chunks"] = (["doc_sections"], f"""SELECT doc_id, section_index raw_index, body AS text,
   CASE WHEN section_index % 4 = 3 THEN '' ELSE 'part ' || (section_index // 3) END section_path,
   [(section_index // 2 + 1)::INT] page_numbers FROM doc_sections""")


@register("merged_sections", sql("raw_chunks", f"""
WITH RECURSIVE c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw_index) i, {sql_light('text')} t, section_path sp, page_numbers[1] pg
   FROM raw_chunks WHERE {sql_light('text')} <> ''),
s AS (SELECT doc_id, i, 1 AS g, length(t) chars, sp FROM c WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN chars + 2 + length(t) ELSE length(t) END, c.sp
  FROM (SELECT s.doc_id, s.i, s.g, s.chars, c.i ci, (c.sp <> '' AND c.sp = s.sp AND (s.chars + 2 + length(c.t) + 3) // 4 <= 300) j
        FROM s JOIN c ON c.doc_id = s.doc_id AND c.i = s.i + 1) x JOIN c ON c.doc_id = x.doc_id AND c.i = x.ci),
m AS (SELECT s.doc_id, g, string_agg(t, {NL} || {NL} ORDER BY s.i) chunk_text, any_value(s.sp) sp, min(pg) page_start, max(pg) page_end FROM s JOIN c ON c.doc_id = s.doc_id AND c.i = s.i GROUP BY s.doc_id, g)
SELECT doc_id, (g - 1)::INT chunk_index, sha256(chunk_text) chunk_hash, sp section_heading, page_start, page_end,
   greatest(1, (length(chunk_text) + 3) // 4)::INT token_count, round_even((g - 1) / max(g) OVER (PARTITION BY doc_id), 4) position_ratio FROM m"""))
def merged_sections(spark, sf):
    raw = ch.sections(heading_text(spark, sf)).selectExpr(
        "doc_id", "section_index raw_index", "body text",
        "CASE WHEN section_index % 4 = 3 THEN '' ELSE concat('part ', section_index div 3) END section_path",
        "array(cast(section_index div 2 + 1 as int)) page_numbers")
    return ch.merge_same_section(raw, 300).select(
        "doc_id", "chunk_index", "chunk_hash", "section_heading", "page_start", "page_end", "token_count", "position_ratio")


META_SPARK = """CASE cast(doc_id % 5 as int)
  WHEN 0 THEN concat('{"headings": ["Part ', doc_id % 7, '", " ", "Art ', doc_id % 3, '"], "page": ', doc_id % 9, '}')
  WHEN 1 THEN concat('{"title": "  Title ', doc_id % 4, ' ", "pages": [3, 1, ', doc_id % 6, ']}')
  WHEN 2 THEN concat('{"section": "", "path": "p/', doc_id, '", "page_start": 2, "page_end": ', 2 + doc_id % 3, '}')
  WHEN 3 THEN '{"headings": [], "outline": "O"}' ELSE '{"other": 1}' END"""


@register("metadata_probe", """SELECT doc_id, CASE doc_id % 5
   WHEN 0 THEN 'Part ' || (doc_id % 7) || ' > Art ' || (doc_id % 3) WHEN 1 THEN 'Title ' || (doc_id % 4)
   WHEN 2 THEN 'p/' || doc_id WHEN 3 THEN 'O' ELSE '' END section_path,
  CASE doc_id % 5 WHEN 0 THEN (doc_id % 9)::VARCHAR
   WHEN 1 THEN array_to_string(list_sort(list_distinct([3, 1, doc_id % 6])), ',')
   WHEN 2 THEN array_to_string(list_sort(list_distinct([2, 2 + doc_id % 3])), ',') ELSE '' END page_numbers FROM documents""")
def metadata_probe(spark, sf):
    raw = text_table(spark, sf, "documents").selectExpr("doc_id", META_SPARK + " meta")
    return ch.probe_metadata(raw).select(
        "doc_id", "section_path", F.array_join(F.transform("page_numbers", lambda n: n.cast("string")), ",").alias("page_numbers"))


def external_lists(spark, sf):
    """Chunk lists as an outside model would write them, some broken in known ways."""
    head = F.replace(F.replace(F.col("text"), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    item = F.concat(F.lit('{"section_heading": "H'), F.col("doc_id") % 5, F.lit('", "chunk_text": "'), head,
                    F.lit('", "sensitivity": '), F.col("doc_id") % 7, F.lit("}"))
    two = F.concat(item, F.lit(', {"section_heading": "", "chunk_text": "tail '), F.col("doc_id"), F.lit('"}'))
    whole = F.concat(F.lit('{"outline_checklist": [], "chunks": ['), two, F.lit("]}"))
    raw = (F.when(F.col("doc_id") % 6 == 0, whole)
           .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
           .when(F.col("doc_id") % 6 == 2, F.concat(whole, F.lit(" trailing words")))
           .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("["), two, F.lit("]")))
           .when(F.col("doc_id") % 6 == 4, F.concat(F.lit('answer {note: x, "chunks": ['), two, F.lit("]} end")))
           .otherwise(F.lit("no json here")))
    return text_table(spark, sf, "documents").select(
        "doc_id", (1 + F.col("doc_id") % 5).cast("int").alias("sensitivity"), raw.alias("raw"))


EXTERNAL_SQL = f"""WITH d AS (SELECT doc_id, (1 + doc_id % 5)::INT s, doc_id % 7 raw,
    trim(replace(replace(text, '"', ''''), {NL}, ' '), {BLANKS}) t FROM documents WHERE doc_id % 6 <> 5),
i AS (SELECT doc_id, 0 k, t, 'H' || (doc_id % 5) h, CASE WHEN raw = 0 THEN s ELSE raw END r, s FROM d
  UNION ALL SELECT doc_id, 1, 'tail ' || doc_id, '', s, s FROM d),
w AS (SELECT *, {sql_words('t')} ws FROM i WHERE t <> ''),
p AS (SELECT doc_id, k, 0 j, t, h, r, s FROM w WHERE (length(t) + 3) // 4 <= 80
  UNION ALL SELECT doc_id, k, j, array_to_string(ws[j * 32 + 1 : j * 32 + 40], ' '), h, r, s
  FROM (SELECT *, unnest(range(0, 1 + greatest(0, ceil((len(ws) - 40) / 32.0)::BIGINT))) j FROM w WHERE (length(t) + 3) // 4 > 80)),
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 chunk_index, t, h,
   greatest(1, least(5, greatest(s - 1, least(s + 1, r)))) chunk_sensitivity FROM p)"""


@register("external_chunk_lists", EXTERNAL_SQL + """
SELECT doc_id, chunk_index, sha256(t) chunk_hash, h section_heading, chunk_sensitivity, round_even(chunk_index / 2, 4) position_ratio FROM x""")
def external_chunk_lists(spark, sf):
    parsed = ch.parse_chunk_lists(external_lists(spark, sf))
    return ch.external_chunks(parsed, ch.ChunkSettings(max_tokens=40, overlap_tokens=8)).select(
        "doc_id", "chunk_index", "chunk_hash", "section_heading", "chunk_sensitivity", "position_ratio")


@register("chunk_mode_fallback", sql("", f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 5 THEN 'legacy' ELSE 'llm_structured' END chunker_mode
  FROM documents WHERE trim(text, {BLANKS}) <> ''"""))
def chunk_mode_fallback(spark, sf):
    docs = text_table(spark, sf, "documents").selectExpr(
        "doc_id", "text", "CASE WHEN doc_id % 4 = 0 THEN 'legacy' ELSE 'llm_structured' END mode")
    out = ch.chunk_by_mode(docs, external_lists(spark, sf), ch.ChunkSettings(max_tokens=40, overlap_tokens=8))
    return out.select("doc_id", "chunker_mode").distinct()


fx.CTE["grouped_fallback"] = (["pieces"], fx.CTE["grouped_pieces"][1].replace("tokens >= 10", f"tokens >= {fixed.FALLBACK_MIN_TOKENS}"))
MODE = "CASE WHEN doc_id % 4 = 0 THEN 'legacy' ELSE 'llm_structured' END mode"


@register("mode_chunks", sql("packed_chunks grouped_fallback", EXTERNAL_SQL.replace("<= 80", "<= 120").replace("> 80", "> 120").replace("* 32", "* 48").replace("/ 32.0", "/ 48.0").replace(
    "+ 40]", "+ 60]").replace("len(ws) - 40", "len(ws) - 60") + f""",
m AS (SELECT doc_id, {MODE} FROM documents),
f AS (SELECT doc_id, (g - 1)::INT chunk_index, sum(tokens)::INT token_count, sha256(arg_min(text, o)) chunk_hash FROM grouped_fallback GROUP BY doc_id, g)
SELECT doc_id, chunk_index, token_count, chunk_hash, 'legacy' chunker_mode FROM packed_chunks JOIN m USING (doc_id) WHERE mode = 'legacy'
UNION ALL SELECT doc_id, chunk_index, (length(t) + 3) // 4, sha256(t), 'llm_structured' FROM x JOIN m USING (doc_id) WHERE mode <> 'legacy'
UNION ALL SELECT doc_id, chunk_index, token_count, chunk_hash, 'legacy' FROM f JOIN m USING (doc_id) WHERE mode <> 'legacy' AND doc_id NOT IN (SELECT doc_id FROM x)"""))
def mode_chunks(spark, sf):
    """All chunks of a corpus in two modes; documents without a usable outside list are packed by sentences."""
    docs = heading_text(spark, sf).selectExpr("*", MODE)
    return ch.chunk_by_mode(docs, external_lists(spark, sf), PACK).select(
        "doc_id", "chunk_index", "token_count", "chunk_hash", "chunker_mode")


@register("chunk_settings", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'llm_structured' WHEN 1 THEN 'legacy' WHEN 2 THEN 'odd' ELSE 'hybrid' END AS mode,
  CASE WHEN doc_id % 4 IN (1, 3) THEN 32 * (doc_id % 100) ELSE 1500 END::INT max_tokens,
  CASE WHEN doc_id % 4 = 3 THEN 100 * (doc_id % 8) ELSE 80 END::INT overlap_tokens,
  CASE WHEN doc_id % 4 = 2 THEN false WHEN doc_id % 4 = 3 THEN doc_id % 8 = 3 AND 32 * (doc_id % 100) BETWEEN 64 AND 4096
    WHEN doc_id % 4 = 0 THEN true ELSE 32 * (doc_id % 100) BETWEEN 64 AND 4096 END valid FROM documents""")
def chunk_settings(spark, sf):
    configs = text_table(spark, sf, "documents").selectExpr("doc_id", """CASE cast(doc_id % 4 as int) WHEN 0 THEN NULL
      WHEN 1 THEN concat('{"mode": "legacy", "max_tokens": ', 32 * (doc_id % 100), '}')
      WHEN 2 THEN '{"mode": "odd"}'
      ELSE concat('{"mode": "hybrid", "max_tokens": ', 32 * (doc_id % 100), ', "overlap_tokens": ', 100 * (doc_id % 8), '}') END config""")
    out = ch.chunk_config(configs)
    return out.select("doc_id", "mode", "max_tokens", "overlap_tokens", "valid")


# ---- tables -----------------------------------------------------------------------------------

def pipe_cells(spark, sf):
    """Cells of the pipe tables in documents, with an empty and a split column planted."""
    rows = text_table(spark, sf, "documents").where(F.col("text").contains("|")).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    cells = rows.select("doc_id", "row_no", F.posexplode(F.split("line", r"\|")).alias("k", "cell"))
    return cells.selectExpr(
        "doc_id", "row_no", "k * 2 + (row_no + k) % 2 col_no", "CASE WHEN k = 2 THEN ' ' ELSE cell END cell")


@register("table_markdown", f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 row_no FROM (SELECT doc_id, string_split(text, {NL}) ls FROM documents WHERE contains(text, '|'))),
k AS (SELECT doc_id, row_no, unnest(cs) cell, generate_subscripts(cs, 1) - 1 k FROM (SELECT doc_id, row_no, string_split(line, '|') cs FROM r)),
c AS (SELECT doc_id, row_no, k * 2 + (row_no + k) % 2 col_no, CASE WHEN k = 2 THEN '' ELSE trim(cell, {BLANKS}) END cell FROM k),
cols AS (SELECT doc_id, col_no, row_number() OVER (PARTITION BY doc_id ORDER BY col_no) n FROM (SELECT DISTINCT doc_id, col_no FROM c WHERE cell <> '')),
f AS (SELECT doc_id, row_no, n, cell FROM c JOIN cols USING (doc_id, col_no) WHERE cell <> ''),
clash AS (SELECT DISTINCT a.doc_id, a.n FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.row_no = b.row_no AND b.n = a.n + 1 AND a.cell <> b.cell),
g AS (SELECT doc_id, 0::BIGINT n, 0 o, false free FROM (SELECT DISTINCT doc_id FROM cols)
  UNION ALL SELECT g.doc_id, cols.n, CASE WHEN free THEN o ELSE o + 1 END, NOT free AND NOT EXISTS (SELECT 1 FROM clash x WHERE x.doc_id = cols.doc_id AND x.n = cols.n)
  FROM g JOIN cols ON cols.doc_id = g.doc_id AND cols.n = g.n + 1),
m AS (SELECT doc_id, row_no, o, arg_min(cell, n) cell FROM f JOIN g USING (doc_id, n) GROUP BY ALL),
grid AS (SELECT rows_.doc_id, row_no, w.o, w.nmax FROM (SELECT DISTINCT doc_id, row_no FROM c) rows_ JOIN (SELECT doc_id, max(o) nmax, unnest(range(1, max(o) + 1)) o FROM g GROUP BY doc_id) w USING (doc_id)),
l AS (SELECT grid.doc_id, grid.row_no, any_value(nmax) nmax, '| ' || string_agg(coalesce(m.cell, ''), ' | ' ORDER BY grid.o) || ' |' line
  FROM grid LEFT JOIN m ON m.doc_id = grid.doc_id AND m.row_no = grid.row_no AND m.o = grid.o GROUP BY grid.doc_id, grid.row_no)
SELECT doc_id, sha256(arg_min(line, row_no) || {NL} || '| ' || array_to_string(list_transform(range(any_value(nmax)), lambda x: '---'), ' | ') || ' |'
  || coalesce({NL} || string_agg(CASE WHEN row_no > 0 THEN line END, {NL} ORDER BY row_no), '')) markdown_hash, any_value(nmax)::INT n_columns FROM l GROUP BY doc_id""")
def table_markdown(spark, sf):
    out = ch.table_to_markdown(pipe_cells(spark, sf))
    head = F.split_part("markdown", F.lit("\n"), F.lit(2))
    return out.select("doc_id", F.sha2("markdown", 256).alias("markdown_hash"),
                      F.regexp_count(head, F.lit("---")).alias("n_columns"))
