"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import text as tx
from sievegate.operators import conversation as cv
from sievegate.operators import maintenance as mt
from sievegate.operators import retrieval as rt
from sievegate.operators.common import rows_of
from sievegate.plans import fixtures as fx
from sievegate.plans.corpus import BLANKS, sql_words
from sievegate.plans.fixtures import CTE, quote, sql
from sievegate.plans.registry import register
from sievegate.plans.search import search_parts
from sievegate.session import shared_dir
from sievegate.sources.tables import table, text_table

DONE = ", ".join(f"'{s}'" for s in fixed.DONE_STATUSES)
TAKEN = """(next_status IN (""" + DONE + f""") OR (next_status = 'streaming' AND length(trim(next_content, {BLANKS})) > 10))"""
ORDER = "PARTITION BY conv_id ORDER BY created_s, message_id"
CTE["pairs"] = (["messages"], f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY created_s, message_id) - 1 pair_no, message_id user_message_id, next_id reply_id,
    content question, next_content answer FROM (SELECT *, lead(role) OVER ({ORDER}) next_role, lead(status) OVER ({ORDER}) next_status, lead(content) OVER ({ORDER}) next_content,
    lead(message_id) OVER ({ORDER}) next_id FROM messages) WHERE role = 'user' AND next_role = 'assistant' AND {TAKEN}""")
CTE["pairs2"] = (["pairs"], "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair_no DESC) <= 3 is_recent, count(*) OVER (PARTITION BY conv_id) n FROM pairs")


def long_messages(spark, sf):
    """Conversations of one starter group joined into longer threads of up to twelve."""
    return fx.messages(spark, sf).selectExpr(
        "concat('t', conv_id div 12, '-', conv_id % 12, '-', turn) message_id", "conv_id div 12 conv_id", "role", "content", "status",
        "CASE WHEN turn > 0 THEN concat('t', conv_id div 12, '-', conv_id % 12, '-', turn - 1) END parent_message_id",
        "(conv_id % 12) * 100000 + created_s created_s")


CTE["threads"] = (["messages"], """SELECT 't' || (conv_id // 12) || '-' || (conv_id % 12) || '-' || turn message_id, conv_id // 12 conv_id, role, content, status,
   CASE WHEN turn > 0 THEN 't' || (conv_id // 12) || '-' || (conv_id % 12) || '-' || (turn - 1) END parent_message_id, (conv_id % 12) * 100000 + created_s created_s FROM messages""")
CTE["pairs"] = (["threads"], CTE["pairs"][1].replace("FROM messages", "FROM threads"))


def pairs(spark, sf):
    return cv.qa_pairs(long_messages(spark, sf))


@register("qa_pairs", sql("pairs", "SELECT conv_id, pair_no, user_message_id, reply_id, sha256(question || '|' || answer) pair_hash FROM pairs"))
def qa_pairs(spark, sf):
    return pairs(spark, sf).select("conv_id", "pair_no", "user_message_id", "reply_id",
                                   F.sha2(F.concat_ws("|", "question", "answer"), 256).alias("pair_hash"))


def stream_messages(spark, sf):
    """A hundred conversations joined into one thread of several hundred messages."""
    return fx.messages(spark, sf).selectExpr(
        "message_id", "conv_id div 100 conv_id", "role", "content", "status", "(conv_id % 100) * 100000 + created_s created_s")


CTE["streams"] = (["messages"], """SELECT message_id, conv_id // 100 conv_id, role, content, status, (conv_id % 100) * 100000 + created_s created_s FROM messages""")
CTE["stream_pairs"] = (["streams"], CTE["pairs"][1].replace("FROM threads", "FROM streams"))
CTE["recent_pairs"] = (["streams"], CTE["pairs"][1].replace("FROM threads", f"""FROM (
    SELECT * FROM streams QUALIFY row_number() OVER ({ORDER}) <= {fixed.HISTORY_MESSAGES})"""))
PAIR_HASH = "SELECT conv_id, pair_no, user_message_id, reply_id, sha256(question || '|' || answer) pair_hash FROM"


def hashed_pairs(rows):
    return rows.select("conv_id", "pair_no", "user_message_id", "reply_id",
                       F.sha2(F.concat_ws("|", "question", "answer"), 256).alias("pair_hash"))


@register("whole_thread_pairs", sql("stream_pairs", f"{PAIR_HASH} stream_pairs"))
def whole_thread_pairs(spark, sf):
    """All pairs of threads of several hundred messages."""
    return hashed_pairs(cv.qa_pairs(stream_messages(spark, sf)))


@register("history_read_pairs", sql("recent_pairs", f"{PAIR_HASH} recent_pairs"))
def history_read_pairs(spark, sf):
    """The feature's own limit: one read of a history takes its first 200 messages."""
    return hashed_pairs(cv.qa_pairs(stream_messages(spark, sf), fixed.HISTORY_MESSAGES))


@register("first_messages", sql("threads", f"SELECT conv_id, count(*) n, max(created_s) last_s FROM (SELECT * FROM threads QUALIFY row_number() OVER ({ORDER}) <= 20) GROUP BY 1"))
def first_messages(spark, sf):
    return cv.first_messages(long_messages(spark, sf), 20).groupBy("conv_id").agg(
        F.count("*").alias("n"), F.max("created_s").alias("last_s"))


ASKED = "SELECT DISTINCT conv_id // 12 conv_id, first_value(text) OVER (PARTITION BY conv_id // 12 ORDER BY conv_id DESC, turn DESC) query FROM conversations"


def asked(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id div 12 conv_id", "conv_id c", "turn", "text")
    return rows.groupBy("conv_id").agg(F.max_by("text", F.struct("c", "turn")).alias("query"))


CTE["asked_texts"] = ([], ASKED)
CTE["relevant"] = (["pairs2", "asked_texts"], f"""SELECT conv_id, pair_no, question, answer, overlap, r - 1 rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, pair_no) r FROM (
    SELECT p.*, len(list_intersect(list_distinct({sql_words('lower(query)')}), list_distinct({sql_words('lower(question)')}))) overlap
    FROM pairs2 p JOIN asked_texts USING (conv_id) WHERE NOT is_recent) WHERE overlap > 0) WHERE r <= 3""")


@register("relevant_pairs", sql("relevant", "SELECT conv_id, pair_no, overlap::INT overlap, rank::INT AS rank FROM relevant"))
def relevant_pairs(spark, sf):
    return cv.relevant_pairs(pairs(spark, sf), asked(spark, sf)).select("conv_id", "pair_no", "overlap", "rank")


CTE["hist"] = (["relevant", "pairs2"], f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, o, i) - 1 turn_no, role, content FROM (
    SELECT conv_id, 2 part, pair_no o, 0 i, 'user' AS role, question AS content FROM pairs2 WHERE is_recent UNION ALL SELECT conv_id, 2, pair_no, 1, 'assistant', answer FROM pairs2 WHERE is_recent
    UNION ALL SELECT conv_id, 1, rank, 0, 'user', question FROM relevant UNION ALL SELECT conv_id, 1, rank, 1, 'assistant', answer FROM relevant
    UNION ALL SELECT DISTINCT conv_id, 0, 0, 0, 'system', {quote(fixed.SUMMARY_HEADER.strip())} || chr(10) || 'sum ' || conv_id FROM pairs2 WHERE conv_id % 2 = 0)""")


def history_rows(spark, sf):
    p = pairs(spark, sf)
    summaries = asked(spark, sf).selectExpr("conv_id", "CASE WHEN conv_id % 2 = 0 THEN concat(' sum ', conv_id) ELSE ' ' END summary")
    return cv.history(p, asked(spark, sf), summaries)


@register("chat_history", sql("hist", "SELECT conv_id, turn_no, role, sha256(content) content_hash FROM hist"))
def chat_history(spark, sf):
    return history_rows(spark, sf).select("conv_id", "turn_no", "role", F.sha2("content", 256).alias("content_hash"))


@register("summaries_due", sql("pairs2", """SELECT conv_id, n n_pairs, sha256(string_agg('User: ' || question || chr(10) || 'Assistant: ' || answer, chr(10) ORDER BY pair_no)) text_hash
  FROM pairs2 WHERE n >= 9 AND NOT is_recent GROUP BY ALL"""))
def summaries_due(spark, sf):
    return cv.summaries_due(pairs(spark, sf)).select("conv_id", "n_pairs", F.sha2("older_text", 256).alias("text_hash"))


@register("context_turns", sql("hist", f"""SELECT conv_id, sha256(string_agg(CASE WHEN role = 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' || content[1:300], chr(10) ORDER BY turn_no)) context_hash
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no DESC) r FROM hist WHERE role <> 'system') WHERE r <= 6 GROUP BY 1"""))
def context_turns(spark, sf):
    return cv.context_text(history_rows(spark, sf)).select("conv_id", F.sha2("context", 256).alias("context_hash"))


@register("recent_turns", sql("threads", f"""SELECT a.conv_id, (3 - r)::INT turn_no, a.message_id, sha256(coalesce(u.content, '') || '|' || a.content) turn_hash FROM (
   SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_s DESC, message_id DESC) r FROM threads WHERE role = 'assistant' AND status IN ({DONE}) AND content <> '') a
   LEFT JOIN threads u ON u.message_id = a.parent_message_id WHERE r <= 3"""))
def recent_turns(spark, sf):
    return cv.recent_turns(long_messages(spark, sf)).select(
        "conv_id", "turn_no", "message_id", F.sha2(F.concat_ws("|", "question", "answer"), 256).alias("turn_hash"))


CTE["sources"] = (["messages"], """SELECT message_id, k source_no, conv_id % 7 + k document_id FROM messages, (SELECT unnest(range(3)) k) WHERE role = 'assistant' AND k <= turn % 4""")


def message_sources(spark, sf):
    return fx.messages(spark, sf).where("role = 'assistant'").selectExpr(
        "message_id", "conv_id", "explode(sequence(0, cast(least(2, turn % 4) as int))) source_no").selectExpr(
        "message_id", "source_no", "conv_id % 7 + source_no document_id")


@register("flat_messages", sql("messages sources", f"""SELECT u.conv_id, u.message_id, coalesce(r.message_id, 'none') reply_id, coalesce(r.status, 'none') reply_status, coalesce(docs, '') source_documents FROM messages u
  LEFT JOIN (SELECT * FROM messages WHERE role = 'assistant' AND status IN ({DONE}) AND content <> '' QUALIFY row_number() OVER (PARTITION BY parent_message_id ORDER BY created_s DESC, message_id DESC) = 1) r ON r.parent_message_id = u.message_id
  LEFT JOIN (SELECT message_id, string_agg(document_id::VARCHAR, ',' ORDER BY source_no) docs FROM sources GROUP BY 1) s ON s.message_id = r.message_id WHERE u.role = 'user'"""))
def flat_messages(spark, sf):
    return cv.flat_messages(fx.messages(spark, sf), message_sources(spark, sf)).select(
        "conv_id", "message_id", F.coalesce("reply_id", F.lit("none")).alias("reply_id"),
        F.coalesce("reply_status", F.lit("none")).alias("reply_status"), "source_documents")


@register("finished_replies", sql("messages", f"SELECT status, count(*) n FROM messages WHERE role = 'assistant' AND status IN ({DONE}) AND content <> '' GROUP BY 1"))
def finished_replies(spark, sf):
    return cv.finished(fx.messages(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


def cited_answers(spark, sf):
    rows = fx.messages(spark, sf).where("role = 'assistant'")
    marks = "CASE WHEN turn % 4 = 3 THEN '' ELSE concat(' [', conv_id % 4 + 1, '] x [', turn % 3 + 2, '] y [', conv_id % 4 + 1, '] z [9]') END"
    return rows.selectExpr(
        "message_id answer_id", f"concat(content, {marks}) answer",
        "transform(sequence(0, 4), k -> named_struct('document_id', (conv_id + k) % 3, 'restricted', (turn + k) % 2 = 0)) sources")


CTE["cited"] = (["messages"], """SELECT message_id, conv_id, turn, content head, turn % 4 = 3 plain, list_sort(list_distinct([conv_id % 4 + 1, turn % 3 + 2, 9])) ns FROM messages WHERE role = 'assistant'""")


@register("citations", sql("cited", """SELECT message_id answer_id, sha256(CASE WHEN plain THEN head ELSE head || ' [' || list_position(ns, conv_id % 4 + 1) || '] x [' || list_position(ns, turn % 3 + 2) || '] y ['
    || list_position(ns, conv_id % 4 + 1) || '] z [' || list_position(ns, 9) || ']' END) answer_hash,
  CASE WHEN plain THEN array_to_string(list_transform(list_filter(range(5), lambda k, i: (turn + k) % 2 = 0 AND len(list_filter(range(k), lambda j: (turn + j) % 2 = 0 AND (conv_id + j) % 3 = (conv_id + k) % 3)) = 0), lambda k: ((conv_id + k) % 3)::VARCHAR), ',')
    ELSE array_to_string(list_transform(list_filter(ns, lambda n: n <= 5), lambda n: ((conv_id + n - 1) % 3)::VARCHAR), ',') END source_documents FROM cited"""))
def citations(spark, sf):
    return cv.normalize_citations(cited_answers(spark, sf)).select(
        "answer_id", F.sha2("answer", 256).alias("answer_hash"),
        F.array_join(F.transform("kept_sources", lambda s: s["document_id"].cast("string")), ",").alias("source_documents"))


@register("answer_sources", sql("cited", """SELECT count(*) n_rows, count(DISTINCT message_id) n_answers FROM (SELECT message_id, unnest(list_filter(ns, lambda n: n <= 5)) FROM cited WHERE NOT plain
   UNION ALL SELECT message_id, unnest(list_filter(range(5), lambda k: (turn + k) % 2 = 0 AND len(list_filter(range(k), lambda j: (turn + j) % 2 = 0 AND (conv_id + j) % 3 = (conv_id + k) % 3)) = 0)) FROM cited WHERE plain)"""))
def answer_sources(spark, sf):
    rows = cv.source_rows(cv.normalize_citations(cited_answers(spark, sf)))
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("answer_id").alias("n_answers"))


@register("client_dedup", sql("messages", """SELECT conv_id, count(*) n, min(message_id) first_id FROM (
   SELECT conv_id, message_id FROM messages WHERE turn % 5 <> 4 QUALIFY row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY created_s, message_id) = 1
   UNION ALL SELECT conv_id, message_id FROM messages WHERE turn % 5 = 4) GROUP BY 1"""))
def client_dedup(spark, sf):
    rows = fx.messages(spark, sf).withColumn(
        "client_message_id", F.expr("CASE WHEN turn % 5 <> 4 THEN concat('k', turn div 2) END"))
    return cv.first_per_client_id(rows).groupBy("conv_id").agg(F.count("*").alias("n"), F.min("message_id").alias("first_id"))


NOANS = " OR ".join(f"contains(lower(answer), {quote(p)})" for p in fixed.NO_ANSWER_PHRASES)


@register("answer_status", sql("messages", f"""SELECT message_id, CASE WHEN turn = 5 THEN 'blocked' WHEN conv_id % 13 = 0 THEN 'success' WHEN conv_id % 11 = 0 OR conv_id % 7 = 0 OR trim(answer) = '' THEN 'fallback'
   WHEN {NOANS} THEN 'no_answer' ELSE 'success' END status FROM (SELECT *, CASE conv_id % 5 WHEN 0 THEN content || ' I cannot answer' WHEN 1 THEN '  ' WHEN 2 THEN 'Không tìm thấy' ELSE content END answer FROM messages WHERE role = 'assistant')"""))
def answer_status(spark, sf):
    rows = fx.messages(spark, sf).where("role = 'assistant'").withColumn("answer", F.expr(
        "CASE cast(conv_id % 5 as int) WHEN 0 THEN concat(content, ' I cannot answer') WHEN 1 THEN '  ' WHEN 2 THEN 'Không tìm thấy' ELSE content END"))
    return rows.select("message_id", cv.answer_status(
        F.col("turn") == 5, F.col("conv_id") % 13 == 0, F.col("conv_id") % 11 != 0, F.col("conv_id") % 7 == 0, F.col("answer")).alias("status"))


@register("think_blocks", """SELECT conv_id, turn, sha256('a ' || text || ' b') text_hash FROM conversations""")
def think_blocks(spark, sf):
    noisy = F.concat(F.lit("a <think>x\ny</think>"), F.col("text"), F.lit("<think></think> b"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha2(F.replace(tx.drop_think_blocks(noisy), F.lit("a "), F.lit("a ")), 256).alias("text_hash"))


@register("markdown_wrap", f"""SELECT conv_id, turn, sha256(CASE WHEN turn % 4 = 0 THEN '  ' WHEN turn % 3 = 0 THEN ' **' || trim(text, {BLANKS}) || '**' || chr(10) WHEN turn % 3 = 1 THEN ' *' || trim(text, {BLANKS}) || '*' || chr(10)
  ELSE ' ***' || trim(text, {BLANKS}) || '***' || chr(10) END) text_hash FROM conversations""")
def markdown_wrap(spark, sf):
    mark = F.expr("element_at(array('**', '*', '***'), cast(turn % 3 as int) + 1)")
    text = F.expr("CASE WHEN turn % 4 = 0 THEN '  ' ELSE concat(' ', btrim(text, ' \\n'), '\\n') END")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(tx.markdown_wrap(text, mark), 256).alias("text_hash"))


# ---- answers from search results -------------------------------------------------------------

def retrieved(spark, sf):
    chunks, vecs, queries, qv = search_parts(spark, sf)
    shared_dir(spark)
    found = rt.search(chunks, vecs, queries, qv).checkpoint()  # a few rows per query
    texts = rows_of(chunks.select("chunk_id", F.col("chunk_text").alias("document_text")), found, "chunk_id")
    return found.join(texts, "chunk_id").withColumn("page", F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id") % 9))


CTE["top5"] = (["scored", "chunk_index"], """SELECT s.*, chunk_text document_text, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) - 1 rank FROM scored) s
   JOIN chunk_index USING (chunk_id) WHERE rank < 5""")


@register("excerpt_answers", sql("top5", "SELECT query_id, sha256(string_agg(document_text, chr(10) || chr(10) ORDER BY rank)) answer_hash, count(*)::INT n_sources FROM top5 GROUP BY 1"))
def excerpt_answers(spark, sf):
    return cv.excerpt_answers(retrieved(spark, sf)).select("query_id", F.sha2("answer", 256).alias("answer_hash"), "n_sources")


@register("prompt_contexts", sql("top5 queries", f"""SELECT query_id, sha256(trim(text, {BLANKS})) question_hash, sha256(ctx) context_hash FROM queries LEFT JOIN (
   SELECT query_id, string_agg('[Context ' || (rank + 1) || '] | chunk_id=' || chunk_id || CASE WHEN chunk_id % 2 = 0 THEN ' | page=' || (chunk_id % 9) ELSE '' END || chr(10) || trim(document_text, {BLANKS}), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) ctx
   FROM top5 GROUP BY 1) USING (query_id)"""))
def prompt_contexts(spark, sf):
    rows = retrieved(spark, sf).withColumn("score", F.lit(None).cast("string"))
    context = cv.prompt_contexts(rows)
    turns = history_rows(spark, sf).withColumnRenamed("conv_id", "query_id")
    out = cv.prompt_rows(fx.queries(spark, sf), context, turns)
    return out.select("query_id", F.sha2("question", 256).alias("question_hash"), F.sha2("context", 256).alias("context_hash"))


@register("source_entries", sql("top5 docs", """SELECT query_id, document_id, title, score relevance, sha256(document_text) excerpt_hash FROM (SELECT *, chunk_id document_id FROM top5) JOIN docs ON doc_id = document_id"""))
def source_entries(spark, sf):
    docs = fx.documents(spark, sf).selectExpr("doc_id chunk_id", "title")
    return retrieved(spark, sf).join(docs, "chunk_id").select(
        "query_id", F.col("chunk_id").alias("document_id"), "title", F.col("score").alias("relevance"),
        F.sha2("document_text", 256).alias("excerpt_hash"))


# One in three threads asks without a vector; so do some questions.
CTE["asked_vectors"] = ([], "SELECT vec_id conv_id, embedding FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id IN (SELECT conv_id // 12 FROM conversations)")
CTE["question_vectors"] = ([], """SELECT 't' || (conv_id // 12) || '-' || (conv_id % 12) || '-' || turn message_id, embedding
   FROM conversations JOIN embeddings ON vec_id = (conv_id * 8 + turn) % 600""")


@register("relevant_by_vector", sql("pairs2 relevant asked_vectors question_vectors", """
WITH v AS (SELECT conv_id, pair_no, coalesce(round(list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
     / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 9), 0) relevance
   FROM pairs2 JOIN asked_vectors a USING (conv_id) LEFT JOIN question_vectors q ON message_id = user_message_id WHERE NOT is_recent),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY relevance DESC, pair_no) - 1 rank FROM v)
SELECT conv_id, pair_no, round(relevance, 4) relevance, rank::INT AS rank, 'vector' AS found_by FROM r WHERE rank < 3
UNION ALL SELECT conv_id, pair_no, overlap, rank::INT, 'words' FROM relevant WHERE conv_id NOT IN (SELECT conv_id FROM asked_vectors)"""))
def relevant_by_vector(spark, sf):
    vectors = table(spark, sf, "embeddings")
    turns = table(spark, sf, "conversations")
    asked_vectors = vectors.where("vec_id % 3 <> 0").join(
        turns.selectExpr("conv_id div 12 vec_id").distinct(), "vec_id", "left_semi").selectExpr("vec_id conv_id", "embedding")
    questions = turns.selectExpr(
        "concat('t', conv_id div 12, '-', conv_id % 12, '-', turn) message_id", "(conv_id * 8 + turn) % 600 vec_id").join(vectors, "vec_id")
    found = cv.relevant_by_vector(pairs(spark, sf), asked(spark, sf), asked_vectors, questions.select("message_id", "embedding"))
    return found.select("conv_id", "pair_no", F.round("relevance", 4).alias("relevance"), "rank", F.col("by").alias("found_by"))


CTE["proposed"] = (["messages"], """SELECT conv_id, first(content ORDER BY created_s, message_id) AS text,
   CASE conv_id % 4 WHEN 0 THEN ' "Plan ' || conv_id || '" ' WHEN 1 THEN chr(39) || 'Note' || chr(39) || ' ' WHEN 2 THEN ' "" ' END proposed FROM messages GROUP BY conv_id""")


@register("conversation_titles", sql("proposed", """SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'Plan ' || conv_id WHEN 1 THEN 'Note' ELSE text[1:40] END title FROM proposed"""))
def conversation_titles(spark, sf):
    """Titles from a model, some quoted, some empty or missing."""
    first = fx.messages(spark, sf).groupBy("conv_id").agg(F.min_by("content", F.struct("created_s", "message_id")).alias("text"))
    return cv.conversation_titles(first.withColumn("proposed", F.expr(
        """CASE cast(conv_id % 4 as int) WHEN 0 THEN concat(' "Plan ', conv_id, '" ') WHEN 1 THEN "'Note' " WHEN 2 THEN ' "" ' END""")))


PROMPT_RULES = "Answer from the contexts only.\nName each context you use by its number."


@register("prompts", sql("top5 hist queries", f"""
WITH c AS (SELECT query_id, string_agg('[Context ' || (rank + 1) || '] | chunk_id=' || chunk_id || ' | score=' || score || CASE WHEN chunk_id % 2 = 0 THEN ' | page=' || (chunk_id % 9) ELSE '' END
     || chr(10) || trim(document_text, {BLANKS}), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) ctx FROM top5 WHERE trim(document_text, {BLANKS}) <> '' GROUP BY 1),
t AS (SELECT conv_id query_id, string_agg(role || ': ' || trim(content, {BLANKS}), chr(10) ORDER BY turn_no) past FROM (
     SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no DESC) r FROM hist) WHERE r <= 6 AND trim(content, {BLANKS}) <> '' GROUP BY 1)
SELECT query_id, sha256({quote(fixed.PROMPT_QUESTION)} || chr(10) || trim(text, {BLANKS}) || chr(10) || chr(10) || {quote(fixed.PROMPT_CONTEXT)} || chr(10) || coalesce(ctx, {quote(fixed.PROMPT_NO_CONTEXT)})
   || chr(10) || chr(10) || {quote(fixed.PROMPT_HISTORY)} || chr(10) || coalesce(past, {quote(fixed.PROMPT_NO_HISTORY)}) || chr(10) || chr(10) || {quote(fixed.PROMPT_RULES)} || chr(10)
   || {quote(PROMPT_RULES)} || chr(10) || chr(10) || {quote(fixed.PROMPT_NOTES)} || chr(10) || 'Be short.') prompt_hash FROM queries LEFT JOIN c USING (query_id) LEFT JOIN t USING (query_id)"""))
def prompts(spark, sf):
    """Whole prompts: question, numbered contexts with their scores, the last turns, the caller's rules."""
    turns = history_rows(spark, sf).withColumnRenamed("conv_id", "query_id")
    rows = cv.prompt_rows(fx.queries(spark, sf), cv.prompt_contexts(retrieved(spark, sf)), turns)
    return cv.prompt_texts(rows, PROMPT_RULES, "Be short.").select("query_id", F.sha2("prompt", 256).alias("prompt_hash"))


@register("shown_sources", sql("top5 docs versions", """SELECT query_id, rank::INT AS rank, CASE WHEN chunk_id % 4 = 0 THEN chunk_id::VARCHAR ELSE title END document_title, coalesce(version_id, 'none') version_id,
   CASE WHEN chunk_id % 3 = 0 THEN 'Part ' || chunk_id END section_path, CASE WHEN chunk_id % 5 = 0 THEN 0.5 ELSE score END relevance,
   sha256(CASE WHEN chunk_id % 6 = 1 THEN 'excerpt ' || chunk_id ELSE document_text END) excerpt_hash, chunk_id % 7 = 0 doc_restricted, document_type
   FROM (SELECT *, chunk_id document_id FROM top5) JOIN (SELECT doc_id, title, CASE WHEN document_type = 'general' AND file_name IS NOT NULL THEN lower(split_part(file_name, '.', 2)) ELSE document_type END document_type, version_id
     FROM docs LEFT JOIN (SELECT doc_id, arg_max(file_name, version_no) file_name, arg_max(version_id, version_no) version_id FROM versions GROUP BY 1) USING (doc_id)) ON doc_id = document_id"""))
def shown_sources(spark, sf):
    """Results as a client is shown them, with the registry's type in place of `general`."""
    versions = fx.versions(spark, sf)
    newest = versions.groupBy("doc_id").agg(F.max_by("version_id", "version_no").alias("version_id"))
    docs = fx.documents(spark, sf).join(newest, "doc_id", "left").selectExpr(
        "doc_id document_id", "CASE WHEN doc_id % 4 = 0 THEN '' ELSE title END title", "version_id", "document_type")
    rows = retrieved(spark, sf).withColumn("document_id", F.col("chunk_id")).join(docs, "document_id").selectExpr(
        "query_id", "rank", "document_id", "document_type", "title", "version_id", "CASE WHEN chunk_id % 3 = 0 THEN concat('Part ', chunk_id) END section",
        "CASE WHEN chunk_id % 5 <> 0 THEN score END score", "0.5D relevance", "CASE WHEN chunk_id % 6 = 1 THEN '' ELSE document_text END document_text",
        "concat('excerpt ', chunk_id) excerpt", "CASE WHEN chunk_id % 7 = 0 THEN true WHEN chunk_id % 7 = 1 THEN false END doc_restricted")
    known = mt.document_types(fx.documents(spark, sf), mt.current_versions(versions)).withColumnRenamed("doc_id", "document_id")
    return cv.source_entry(mt.backfilled_types(rows, known), ["query_id", "rank", "document_type"]).select(
        "query_id", "rank", "entry.document_title", F.coalesce("entry.version_id", F.lit("none")).alias("version_id"), "entry.section_path",
        "entry.relevance", F.sha2("entry.excerpt", 256).alias("excerpt_hash"), "entry.doc_restricted", "document_type")
