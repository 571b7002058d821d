"""Retrieval queries: documents stand in as chunks, benchmark passages as searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import scoring as sc
from sievegate.functions import text as tx
from sievegate.operators import access as ac
from sievegate.operators import retrieval as rt
from sievegate.operators import scoped as scp
from sievegate.operators.common import rows_of, top_k
from sievegate.plans import fixtures as fx
from sievegate.plans.corpus import BLANKS, sql_tokens
from sievegate.plans.fixtures import CTE, NOW, sql
from sievegate.plans.governance import LEVELS_SQL
from sievegate.plans.registry import ORACLE, register
from sievegate.session import shared_dir
from sievegate.sources.tables import table, text_table


def chunk_index(spark, sf):
    return text_table(spark, sf, "documents").selectExpr(
        "doc_id chunk_id", "doc_id document_id", "text chunk_text", "cast(1 + doc_id % 5 as int) sensitivity",
        "cast(greatest(1, least(5, 1 + doc_id % 5 + doc_id % 3 - 1)) as int) chunk_sensitivity")


def vectors(spark, sf):
    ids = table(spark, sf, "documents").selectExpr("doc_id vec_id")
    return table(spark, sf, "embeddings").join(ids, "vec_id", "left_semi").selectExpr("vec_id chunk_id", "embedding")


CTE["chunk_index"] = ([], """SELECT doc_id chunk_id, doc_id document_id, text AS chunk_text, (1 + doc_id % 5)::INT sensitivity,
   greatest(1, least(5, 1 + doc_id % 5 + doc_id % 3 - 1))::INT chunk_sensitivity FROM documents""")
CTE["chunk_vectors"] = ([], "SELECT vec_id chunk_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")

# ---- BM25 in SQL
CTE["ct"] = (["chunk_index"], f"SELECT chunk_id, unnest(tk) token, len(tk) dl FROM (SELECT chunk_id, {sql_tokens('chunk_text')} tk FROM chunk_index)")
CTE["tf"] = (["ct"], "SELECT chunk_id, token, any_value(dl) dl, count(*) tf FROM ct GROUP BY chunk_id, token")
CTE["cs"] = (["ct"], "SELECT count(*) n_chunks, avg(dl) avg_length FROM (SELECT chunk_id, any_value(dl) dl FROM ct GROUP BY 1)")
CTE["idf0"] = (["tf", "cs"], "SELECT token, count(*) df, ln((SELECT n_chunks FROM cs) - count(*) + 0.5) - ln(count(*) + 0.5) idf FROM tf GROUP BY token")
CTE["idf"] = (["idf0"], "SELECT token, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END idf FROM idf0")
CTE["qt"] = (["queries"], f"SELECT query_id, token, count(*) times FROM (SELECT query_id, unnest({sql_tokens('text')}) token FROM queries) GROUP BY ALL")
CTE["bm"] = (["tf", "cs", "idf", "qt"], """SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg_length FROM cs)))), 9) raw_score
   FROM qt JOIN idf USING (token) JOIN tf USING (token) GROUP BY query_id, chunk_id HAVING raw_score > 0""")
CTE["lexical"] = (["bm"], """SELECT query_id, chunk_id, rank, raw_score, greatest(0.0, 1 - raw_score / max(raw_score) OVER (PARTITION BY query_id)) distance
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) - 1 rank FROM bm) WHERE rank < 20""")
CTE["cos"] = (["query_vectors", "chunk_vectors"], """SELECT query_id, chunk_id, round(
     list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
     / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 12) similarity FROM query_vectors q, chunk_vectors v""")
CTE["semantic"] = (["cos"], """SELECT query_id, chunk_id, rank, similarity, 1 - similarity distance FROM (
     SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) - 1 rank FROM cos) WHERE rank < 20""")
CTE["fused"] = (["semantic", "lexical"], """SELECT query_id, chunk_id, round(sum(1.0 / (61 + rank)), 6) rrf_score,
     string_agg(source, ',' ORDER BY source) sources, max(sd) semantic_distance, max(ld) lexical_distance, max(raw) lexical_raw
   FROM (SELECT query_id, chunk_id, rank, 'semantic' source, distance sd, NULL::DOUBLE ld, NULL::DOUBLE raw FROM semantic
         UNION ALL SELECT query_id, chunk_id, rank, 'lexical', NULL, distance, raw_score FROM lexical) GROUP BY query_id, chunk_id""")
KW = "CASE WHEN lexical_raw > 0 THEN 1 / (1 + exp(-lexical_raw / 5)) ELSE 0 END"
SIM = "greatest(0, least(1, 1 - semantic_distance))"
CTE["scored"] = (["fused"], f"""SELECT *, round(CASE WHEN semantic_distance IS NULL THEN {KW} WHEN lexical_raw IS NULL THEN {SIM}
     ELSE 0.6 * {SIM} + 0.4 * ({KW}) END, 6) score FROM fused""")


def search_parts(spark, sf):
    return (chunk_index(spark, sf), vectors(spark, sf), fx.queries(spark, sf), fx.query_vectors(spark, sf))


# ---- parts ------------------------------------------------------------------------------

@register("vector_cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.selectExpr("vec_id - 1 vec_id", "embedding other")
    return e.join(after, "vec_id").select("vec_id", F.round(sc.cosine("embedding", "other"), 4).alias("similarity"))


@register("semantic_top", sql("semantic", "SELECT query_id, chunk_id, rank::INT AS rank, round(similarity, 4) similarity FROM semantic"))
def semantic_top(spark, sf):
    return rt.cosine_top(vectors(spark, sf), fx.query_vectors(spark, sf)).select(
        "query_id", "chunk_id", "rank", F.round("similarity", 4).alias("similarity"))


@register("semantic_top_grid", sql("semantic", "SELECT query_id, chunk_id, rank::INT AS rank, round(similarity, 4) similarity FROM semantic"))
def semantic_top_grid(spark, sf):
    """The same list by the path for more query vectors than one block holds."""
    return rt.cosine_top(vectors(spark, sf), fx.query_vectors(spark, sf), block=16).select(
        "query_id", "chunk_id", "rank", F.round("similarity", 4).alias("similarity"))


@register("postings", sql("tf", "SELECT chunk_id, count(*) n_tokens, sum(tf)::BIGINT dl, max(tf) max_tf FROM tf GROUP BY chunk_id"))
def postings(spark, sf):
    return rt.token_table(chunk_index(spark, sf)).groupBy("chunk_id").agg(
        F.count("*").alias("n_tokens"), F.sum("tf").alias("dl"), F.max("tf").alias("max_tf"))


@register("corpus_statistics", sql("idf cs", """SELECT (SELECT n_chunks FROM cs) n_chunks, round((SELECT avg_length FROM cs), 4) avg_length,
   count(*) vocabulary, round(avg(idf), 4) mean_idf, max(df) max_df FROM idf"""))
def corpus_statistics(spark, sf):
    stats = rt.corpus_stats(chunk_index(spark, sf)).select(F.struct("n_chunks", "avg_length")).scalar()
    n, avg = stats["n_chunks"], stats["avg_length"]
    idf = rt.token_idf(chunk_index(spark, sf), n)
    return idf.agg(F.count("*").alias("vocabulary"), F.round(F.avg("idf"), 4).alias("mean_idf"),
                   F.max("df").alias("max_df")).select("*", n.alias("n_chunks"), F.round(avg, 4).alias("avg_length"))


@register("bm25_top", sql("lexical", "SELECT query_id, chunk_id, rank::INT AS rank, round(raw_score, 4) raw_score, round(distance, 4) distance FROM lexical"))
def bm25_top(spark, sf):
    return rt.bm25_top(chunk_index(spark, sf), fx.queries(spark, sf)).select(
        "query_id", "chunk_id", "rank", F.round("raw_score", 4).alias("raw_score"), F.round("distance", 4).alias("distance"))


LANG_SCOPE = "chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"


@register("bm25_scoped", sql("lexical", "SELECT query_id, chunk_id, rank::INT AS rank, round(raw_score, 4) raw_score FROM lexical")
          .replace("doc_id % 3 - 1))::INT chunk_sensitivity FROM documents", "doc_id % 3 - 1))::INT chunk_sensitivity FROM documents WHERE lang = 'en'"))
def bm25_scoped(spark, sf):
    """Statistics and scores over one scope: the filter comes before the counts."""
    scope = text_table(spark, sf, "documents").where("lang = 'en'").selectExpr("doc_id chunk_id", "text chunk_text")
    return rt.bm25_top(scope, fx.queries(spark, sf)).select(
        "query_id", "chunk_id", "rank", F.round("raw_score", 4).alias("raw_score"))


@register("keyword_scores", sql("lexical", f"SELECT query_id, chunk_id, round(1 / (1 + exp(-raw_score / 5)), 4) keyword_score FROM lexical"))
def keyword_scores(spark, sf):
    return rt.bm25_top(chunk_index(spark, sf), fx.queries(spark, sf)).select(
        "query_id", "chunk_id", F.round(sc.keyword_score("raw_score"), 4).alias("keyword_score"))


from sievegate.functions import fixed_values as fixed  # noqa: E402

STOP = "[" + ", ".join(fx.quote(w) for w in fixed.STOPWORDS) + "]"


@register("token_f1_top", sql("queries chunk_index", f"""
WITH q0 AS (SELECT query_id, {sql_tokens('text')} tk FROM queries),
q AS (SELECT query_id, tk, CASE WHEN len(list_filter(tk, lambda x: NOT list_contains({STOP}, x))) > 0 THEN list_filter(tk, lambda x: NOT list_contains({STOP}, x)) ELSE tk END mt FROM q0 WHERE len(tk) > 0),
m AS (SELECT query_id, list_distinct(list_transform(tk, lambda x: strip_accents(replace(x, 'đ', 'd')))) s,
   (list_filter(mt, lambda x: length(x) = list_max(list_transform(mt, lambda y: length(y)))))[1] main FROM q),
d AS (SELECT chunk_id, chunk_text, list_distinct(list_transform({sql_tokens('chunk_text')}, lambda x: strip_accents(replace(x, 'đ', 'd')))) s FROM chunk_index),
h AS (SELECT query_id, chunk_id, len(list_intersect(m.s, d.s)) both_, len(m.s) nq, len(d.s) nt, contains(chunk_text, main) inn FROM m, d),
a AS (SELECT query_id, bool_or(inn) anyhit FROM h GROUP BY 1),
f AS (SELECT query_id, chunk_id, 2 * (both_ / nt) * (both_ / nq) / greatest(1e-9, both_ / nt + both_ / nq) f1 FROM h JOIN a USING (query_id) WHERE both_ > 0 AND (inn OR NOT anyhit))
SELECT query_id, chunk_id, rank, round(f1, 4) f1 FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY f1 DESC, chunk_id) - 1)::INT rank FROM f) WHERE rank < 5"""))
def token_f1_top(spark, sf):
    return rt.token_f1_top(chunk_index(spark, sf), fx.queries(spark, sf)).select(
        "query_id", "chunk_id", "rank", F.round("f1", 4).alias("f1"))


@register("rank_fusion", sql("fused", "SELECT query_id, chunk_id, rrf_score, sources FROM fused"))
def rank_fusion(spark, sf):
    chunks, vecs, queries, qv = search_parts(spark, sf)
    return rt.fuse(rt.cosine_top(vecs, qv), rt.bm25_top(chunks, queries)).select(
        "query_id", "chunk_id", "rrf_score", "sources")


@register("display_scores", sql("scored", "SELECT query_id, chunk_id, score FROM scored WHERE score >= 0.1"))
def display_scores(spark, sf):
    chunks, vecs, queries, qv = search_parts(spark, sf)
    fused = rt.fuse(rt.cosine_top(vecs, qv), rt.bm25_top(chunks, queries))
    return rt.with_scores(fused, 0.1).select("query_id", "chunk_id", "score")


@register("search_modes", sql("scored", f"""
WITH m AS (SELECT 'hybrid' AS mode, query_id, chunk_id, rrf_score FROM scored
  UNION ALL SELECT 'semantic', query_id, chunk_id, {SIM} FROM scored WHERE semantic_distance IS NOT NULL
  UNION ALL SELECT 'keyword', query_id, chunk_id, greatest(0, 1 - lexical_distance) FROM scored WHERE lexical_distance IS NOT NULL)
SELECT mode, query_id, chunk_id, rank::INT AS rank, round(rrf_score, 4) rrf_score
FROM (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY rrf_score DESC, chunk_id) - 1 rank FROM m) WHERE rank < 5"""))
def search_modes(spark, sf):
    chunks, vecs, queries, qv = search_parts(spark, sf)
    semantic, lexical = rt.cosine_top(vecs, qv), rt.bm25_top(chunks, queries)
    out = None
    for mode in ("hybrid", "semantic", "keyword"):
        rows = rt.by_mode(semantic, lexical, mode).select(
            F.lit(mode).alias("mode"), "query_id", "chunk_id", "rrf_score")
        out = rows if out is None else out.unionByName(rows)
    return top_k(out, ["mode", "query_id"], rt.fused_order(), 5).withColumn("rrf_score", F.round("rrf_score", 4))


@register("hybrid_search", sql("scored", """SELECT query_id, chunk_id, rank::INT AS rank, rrf_score, score, sources FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) - 1 rank FROM scored) WHERE rank < 5"""))
def hybrid_search(spark, sf):
    chunks, vecs, queries, qv = search_parts(spark, sf)
    return rt.search(chunks, vecs, queries, qv).select(
        "query_id", "chunk_id", "rank", "rrf_score", "score", "sources")


@register("search_capped", sql("scored", """SELECT query_id, chunk_id, rank::INT AS rank, rrf_score FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) - 1 rank FROM scored) WHERE rank < 20"""))
def search_capped(spark, sf):
    """Fifty results asked for: the search's own cap gives twenty."""
    chunks, vecs, queries, qv = search_parts(spark, sf)
    return rt.search(chunks, vecs, queries, qv, k=50).select("query_id", "chunk_id", "rank", "rrf_score")


# ---- two collections -------------------------------------------------------------------------

def mail_chunks(spark, sf):
    """Conversation turns as the mail collection, owned by a user."""
    return table(spark, sf, "conversations").selectExpr(
        "concat('m', conv_id, '-', turn) chunk_id", "conv_id % 150 owner_user_id", "text chunk_text",
        "conv_id * 8 + turn vec_id")


def mail_vectors(spark, sf):
    """Vectors of the mails that have one."""
    return mail_chunks(spark, sf).join(table(spark, sf, "embeddings"), "vec_id").select(
        "chunk_id", "owner_user_id", "embedding")


CTE["mail_index"] = ([], """SELECT 'm' || conv_id || '-' || turn chunk_id, conv_id % 150 owner_user_id, text AS chunk_text,
   conv_id * 8 + turn vec_id FROM conversations""")
# Everything of a mail search is per owner: the filter comes before the statistics.
CTE["mail_tf"] = (["mail_index"], f"""SELECT chunk_id, owner_user_id, token, any_value(dl) dl, count(*) tf FROM (
   SELECT chunk_id, owner_user_id, len(tk) dl, unnest(tk) token FROM (SELECT *, {sql_tokens('chunk_text')} tk FROM mail_index)) GROUP BY ALL""")
CTE["mail_cs"] = (["mail_tf"], """SELECT owner_user_id, count(*) n, avg(dl) a FROM (
   SELECT owner_user_id, chunk_id, any_value(dl) dl FROM mail_tf GROUP BY ALL) GROUP BY 1""")
CTE["mail_idf0"] = (["mail_tf", "mail_cs"], """SELECT owner_user_id, token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) idf
   FROM mail_tf JOIN mail_cs USING (owner_user_id) GROUP BY ALL""")
CTE["mail_idf"] = (["mail_idf0"], """SELECT owner_user_id, token,
   CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY owner_user_id) ELSE idf END idf FROM mail_idf0""")
CTE["mail_bm"] = (["mail_idf", "mail_tf", "mail_cs", "qt", "queries"], """SELECT query_id, chunk_id,
   round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) raw FROM qt JOIN queries USING (query_id)
   JOIN mail_idf i ON i.owner_user_id = user_id AND i.token = qt.token JOIN mail_tf t ON t.owner_user_id = user_id AND t.token = qt.token
   JOIN mail_cs c ON c.owner_user_id = user_id GROUP BY ALL HAVING raw > 0""")
CTE["mail_cos"] = (["query_vectors", "queries", "mail_index"], """SELECT query_id, chunk_id, round(
     list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
     / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 12) sim
   FROM query_vectors q JOIN queries USING (query_id) JOIN mail_index m ON m.owner_user_id = user_id JOIN embeddings v USING (vec_id)""")


def fused_sql(lists: str, k: int) -> str:
    """Both lists of `lists` (cosine, bm25 tables) cut to k, fused and scored like `scored`."""
    cosine, lexical = lists.split()
    return f"""SELECT *, round(CASE WHEN sd IS NULL THEN {KW_RAW} WHEN raw IS NULL THEN {SIM_SD} ELSE 0.6 * {SIM_SD} + 0.4 * ({KW_RAW}) END, 6) score FROM (
   SELECT query_id, chunk_id, round(sum(1.0 / (61 + rank)), 6) rrf_score, string_agg(source, ',' ORDER BY source) sources, max(sd) sd, max(raw) raw FROM (
     SELECT query_id, chunk_id, 'semantic' source, 1 - sim sd, NULL::DOUBLE raw, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) - 1 rank FROM {cosine}
     UNION ALL SELECT query_id, chunk_id, 'lexical', NULL, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) - 1 FROM {lexical})
   WHERE rank < {k} GROUP BY query_id, chunk_id)"""


KW_RAW = "CASE WHEN raw > 0 THEN 1 / (1 + exp(-raw / 5)) ELSE 0 END"
SIM_SD = "greatest(0, least(1, 1 - sd))"
CTE["mail20"] = (["mail_cos", "mail_bm"], fused_sql("mail_cos mail_bm", 20))
CTE["mail40"] = (["mail_cos", "mail_bm"], fused_sql("mail_cos mail_bm", 40))
MAIL_CANDIDATES = 40


@register("collection_switch", sql("scored mail20 mail40", """
WITH d AS (SELECT 'documents' collection, query_id, 'd' || chunk_id chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) r FROM scored),
m AS (SELECT 'mail' collection, query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) r FROM mail20),
g AS (SELECT 'mail' collection, query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) r FROM mail40),
al AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, collection, chunk_id) rank FROM (SELECT * FROM d WHERE r <= 5 UNION ALL SELECT * FROM m WHERE r <= 5))
SELECT 'all' AS mode, query_id, collection, chunk_id, (rank - 1)::INT AS rank, score FROM al WHERE rank <= 5
UNION ALL SELECT 'documents', query_id, collection, chunk_id, (r - 1)::INT, score FROM d WHERE r <= 5
UNION ALL SELECT 'mail', query_id, collection, chunk_id, (r - 1)::INT, score FROM g WHERE r <= 5"""))
def collection_switch(spark, sf):
    """Three sources: documents, the user's own mail with more candidates, and both merged by shown score."""
    chunks, vecs, queries, qv = search_parts(spark, sf)
    shared_dir(spark)
    named = lambda rows, collection: rows.select(
        F.lit(collection).alias("collection"), "query_id", "chunk_id", "rank", "score")
    docs = named(rt.search(chunks, vecs, queries, qv), "documents").withColumn(
        "chunk_id", F.concat(F.lit("d"), "chunk_id")).checkpoint()
    asked = qv.join(queries.select("query_id", "user_id"), "query_id")
    box = (mail_chunks(spark, sf), mail_vectors(spark, sf), queries, asked)
    few = named(scp.collection_of_each(*box), "mail")
    more = named(scp.collection_of_each(*box, candidates=MAIL_CANDIDATES), "mail")
    both = rt.merge_collections([docs.drop("rank"), few.drop("rank")], 5).select(docs.columns)
    out = both.withColumn("mode", F.lit("all")).unionByName(docs.withColumn("mode", F.lit("documents"))).unionByName(
        more.withColumn("mode", F.lit("mail")))
    return out.select("mode", "query_id", "collection", "chunk_id", F.col("rank").cast("int").alias("rank"), "score")


# ---- embeddings ---------------------------------------------------------------------------------

@register("hashed_embeddings", f"""
WITH h AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 slot, count(*) c FROM (SELECT doc_id, unnest({sql_tokens('text')}) t FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(c * c)) nn, max(c) mx, count(*) slots, min(slot) first_slot FROM h GROUP BY 1)
SELECT doc_id, slots used_slots, round((mx / nn)::FLOAT::DOUBLE, 4) top_weight FROM n""")
def hashed_embeddings(spark, sf):
    out = text_table(spark, sf, "documents").select("doc_id", rt.hashed_embedding("text").alias("v")).where(F.size("v") > 0)
    return out.select(
        "doc_id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("used_slots"),
        F.round(F.array_max("v").cast("double"), 4).alias("top_weight"))


@register("encoded_texts", ORACLE["hashed_embeddings"])
def encoded_texts(spark, sf):
    """The same vectors by the encoder hook: one encoder a task, batches of 64 texts, blanks keep their row."""
    rows = rt.encode_texts(text_table(spark, sf, "documents").select("doc_id", "text"), rt.hashed_encoder())
    return rows.where(F.size("embedding") > 0).select(
        "doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("used_slots"),
        F.round(F.array_max("embedding").cast("double"), 4).alias("top_weight"))


# ---- gates ------------------------------------------------------------------------------------------

def access_inputs(spark, sf):
    held, nodes, types = fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf)
    return held, nodes, ac.closure(fx.node_parents(spark, sf)), ac.profiles(held, nodes, types)


def gated_rows(spark, sf, queries, scored):
    shared_dir(spark)
    scored = scored.checkpoint()  # a few rows per query, used by several joins
    held, nodes, pairs, profile = access_inputs(spark, sf)
    index = chunk_index(spark, sf).select("chunk_id", "document_id", "sensitivity", F.expr(
        "CASE chunk_id % 7 WHEN 3 THEN NULL WHEN 5 THEN 0 ELSE chunk_sensitivity END").alias("chunk_sensitivity"))
    index = rows_of(index, scored, "chunk_id")
    wanted = scored.join(queries, "query_id").join(index, "chunk_id").select(
        "user_id", F.col("document_id").alias("doc_id")).distinct().checkpoint()
    docs, doc_nodes = (rows_of(rows, wanted, "doc_id") for rows in (fx.documents(spark, sf), fx.document_nodes(spark, sf)))
    view = ac.access_of_pairs(wanted, docs, doc_nodes, nodes, fx.node_parents(spark, sf), pairs, held, profile)
    grants = ac.active_grants(fx.access_requests(spark, sf), F.lit(NOW).cast("timestamp_ntz"))
    return rt.gate_results(
        scored, index, queries, profile,
        view.where("can_view").select("user_id", F.col("doc_id").alias("document_id")),
        grants.withColumnRenamed("doc_id", "document_id"))


CTE["roots"] = (["nodes", "node_parents", "closure"], """SELECT n.oui_id, coalesce(min(ancestor_id), n.oui_id) root_id FROM nodes n
   LEFT JOIN (SELECT * FROM closure WHERE ancestor_id NOT IN (SELECT oui_id FROM node_parents)) c ON c.oui_id = n.oui_id GROUP BY n.oui_id""")
CTE["tuples"] = (["docs", "doc_nodes", "roots", "closure", "node_parents"], """SELECT doc_id, subject, relation, min(req) required_clearance FROM (
   SELECT doc_id, 'user:' || owner_user_id subject, 'owner' relation, 0 req FROM docs
   UNION ALL SELECT doc_id, 'oui:' || oui_id || '#member', 'viewer', least(sensitivity, 5) FROM docs JOIN doc_nodes USING (doc_id)
   UNION ALL SELECT doc_id, 'oui:' || parent_oui_id || '#ancestor_member', 'viewer', least(sensitivity, 5) FROM docs JOIN doc_nodes USING (doc_id) JOIN node_parents USING (oui_id)
   UNION ALL SELECT doc_id, 'oui:' || root_id || '#member', 'editor', least(sensitivity, 5) FROM docs JOIN doc_nodes USING (doc_id) JOIN roots USING (oui_id)
   UNION ALL SELECT doc_id, 'oui:' || c.oui_id || '#member', 'viewer', 1 FROM docs JOIN doc_nodes d USING (doc_id) JOIN closure c ON c.ancestor_id = d.oui_id WHERE sensitivity = 1)
   GROUP BY ALL""")
CTE["subjects"] = (["user_positions", "closure", "users"], """SELECT DISTINCT user_id, subject FROM (
   SELECT user_id, 'oui:' || oui_id || '#member' subject FROM user_positions
   UNION ALL SELECT user_id, 'oui:' || oui_id || '#ancestor_member' FROM user_positions
   UNION ALL SELECT user_id, 'oui:' || c.oui_id || '#ancestor_member' FROM user_positions p JOIN closure c ON c.ancestor_id = p.oui_id
   UNION ALL SELECT user_id, 'user:' || user_id FROM users)""")
CTE["viewable"] = (["tuples", "subjects", "profiles"], """SELECT user_id, doc_id, bool_or(relation IN ('owner', 'editor')) can_edit
   FROM tuples JOIN subjects USING (subject) LEFT JOIN profiles USING (user_id)
   WHERE relation = 'owner' OR coalesce(max_clearance, 1) >= required_clearance GROUP BY user_id, doc_id""")
CTE["grants"] = (["requests"], f"SELECT DISTINCT user_id, doc_id FROM requests WHERE status = 'approved' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')")
CTE["gated"] = (["scored", "queries", "chunk_index", "profiles", "viewable", "grants"], """
   SELECT *, NOT allowed OR max(chunk_blurred) OVER (PARTITION BY query_id, document_id) doc_restricted FROM (
   SELECT s.*, q.user_id, i.document_id, i.chunk_sensitivity, v.doc_id IS NOT NULL allowed,
     v.doc_id IS NOT NULL AND i.chunk_sensitivity > coalesce(max_clearance, 1) AND g.doc_id IS NULL chunk_blurred
   FROM scored s JOIN queries q USING (query_id) JOIN (SELECT * REPLACE (CASE WHEN chunk_id % 7 IN (3, 5) THEN sensitivity ELSE chunk_sensitivity END AS chunk_sensitivity) FROM chunk_index) i USING (chunk_id) LEFT JOIN profiles p ON p.user_id = q.user_id
   LEFT JOIN viewable v ON v.user_id = q.user_id AND v.doc_id = i.document_id LEFT JOIN grants g ON g.user_id = q.user_id AND g.doc_id = i.document_id
   WHERE v.doc_id IS NOT NULL OR i.chunk_sensitivity <= coalesce(max_clearance, 1))""")

GATED_SQL = """SELECT query_id, chunk_id, user_id, document_id, rank::INT AS rank, score, doc_restricted, chunk_blurred FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) - 1 rank FROM gated) WHERE rank < 5"""
GATED = ["query_id", "chunk_id", "user_id", "document_id", "rank", "score", "doc_restricted", "chunk_blurred"]


@register("gated_search", sql("gated", GATED_SQL))
def gated_search(spark, sf):
    chunks, vecs, queries, qv = search_parts(spark, sf)
    scored = rt.with_scores(rt.fuse(rt.cosine_top(vecs, qv), rt.bm25_top(chunks, queries)))
    rows = gated_rows(spark, sf, queries.select("query_id", "user_id"), scored)
    return top_k(rows, ["query_id"], rt.fused_order(), 5).select(GATED)


@register("gated_search_in_nodes", sql("gated doc_nodes", """
   SELECT query_id, chunk_id, rank::INT AS rank, doc_restricted FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) - 1 rank FROM gated
   WHERE document_id IN (SELECT doc_id FROM doc_nodes WHERE oui_id IN ('n1', 'n2', 'n3', 'n5', 'n8', 'r1', 'c'))) WHERE rank < 5"""))
def gated_search_in_nodes(spark, sf):
    """Only documents of the asked nodes, filtered before the final cut."""
    chunks, vecs, queries, qv = search_parts(spark, sf)
    scored = rt.with_scores(rt.fuse(rt.cosine_top(vecs, qv), rt.bm25_top(chunks, queries)))
    rows = gated_rows(spark, sf, queries.select("query_id", "user_id"), scored)
    nodes = fx.document_nodes(spark, sf).groupBy(F.col("doc_id").alias("document_id")).agg(
        F.collect_set("oui_id").alias("oui_ids"))
    asked = F.array(*[F.lit(n) for n in ("n1", "n2", "n3", "n5", "n8", "r1", "c")])
    kept = rt.overlaps_nodes(rows.join(nodes, "document_id"), asked)
    return top_k(kept, ["query_id"], rt.fused_order(), 5).select("query_id", "chunk_id", "rank", "doc_restricted")


@register("branch_scope", sql("queries viewable user_positions closure doc_nodes", """
WITH b AS (SELECT user_id, oui_id FROM user_positions UNION SELECT user_id, ancestor_id FROM user_positions JOIN closure USING (oui_id)
   UNION SELECT user_id, c.oui_id FROM user_positions p JOIN closure c ON c.ancestor_id = p.oui_id),
s AS (SELECT user_id, doc_id FROM viewable UNION SELECT user_id, doc_id FROM b JOIN doc_nodes USING (oui_id))
SELECT user_id, count(*) n_documents, sum(doc_id)::BIGINT id_sum FROM s WHERE user_id IN (SELECT user_id FROM queries) GROUP BY 1"""))
def branch_scope(spark, sf):
    """Documents in reach of each searching user: own branch plus viewable ones, summed by cell."""
    persons, scopes = scope_tables(spark, sf)
    docs = chunk_cells(table(spark, sf, "documents"), "doc_id").select("doc_id", "cell", "owner_user_id")
    return scp.scope_listing(docs, persons, scopes)


def chunk_cells(rows, doc_id):
    """Metadata that every chunk carries: nodes, level and owner of its document, and the cell they make."""
    nodes = F.expr(f"""filter(array(concat('n', {doc_id} % 25), CASE WHEN {doc_id} % 7 = 0 THEN concat('r', {doc_id} % 5) END,
        CASE WHEN {doc_id} % 31 = 0 THEN 'c' END), x -> x IS NOT NULL)""")
    level = F.expr(f"cast(1 + {doc_id} % 5 as int)")
    return rows.withColumns({
        "oui_ids": nodes, "sensitivity": level, "owner_user_id": F.expr(f"{doc_id} % 150")}).withColumn(
        "cell", scp.cell_key("oui_ids", "sensitivity"))


def scope_tables(spark, sf):
    """Persons with their class, and the cells that each class reaches."""
    shared_dir(spark)
    users = fx.queries(spark, sf).select("user_id").distinct()
    held, nodes, pairs, profile = access_inputs(spark, sf)
    persons = scp.person_classes(users, held, profile).checkpoint()
    cells = chunk_cells(table(spark, sf, "documents").select("doc_id"), "doc_id").select(
        "cell", "oui_ids", "sensitivity").distinct()
    scopes = scp.class_scopes(persons, cells, held, nodes, fx.node_parents(spark, sf), pairs, profile)
    return persons, scopes.checkpoint()


def scoped_parts(spark, sf):
    chunks = chunk_cells(text_table(spark, sf, "documents").selectExpr("doc_id", "doc_id chunk_id", "text chunk_text"), "doc_id")
    vecs = chunk_cells(vectors(spark, sf), "chunk_id")
    queries = fx.queries(spark, sf)
    asked = fx.query_vectors(spark, sf).join(queries.select("query_id", "user_id"), "query_id")
    return chunks, vecs, queries, asked


CTE["reach"] = (["queries", "viewable", "user_positions", "closure", "doc_nodes"], """SELECT DISTINCT user_id, doc_id FROM (
   SELECT user_id, doc_id FROM viewable
   UNION ALL SELECT user_id, doc_id FROM (SELECT user_id, oui_id FROM user_positions UNION SELECT user_id, ancestor_id FROM user_positions JOIN closure USING (oui_id)
     UNION SELECT user_id, c.oui_id FROM user_positions p JOIN closure c ON c.ancestor_id = p.oui_id) JOIN doc_nodes USING (oui_id))
   WHERE user_id IN (SELECT user_id FROM queries)""")
CTE["rtf"] = (["reach", "tf"], "SELECT user_id, chunk_id, token, dl, tf FROM reach JOIN tf ON chunk_id = doc_id")
CTE["rcs"] = (["rtf"], "SELECT user_id, count(*) n, avg(dl) a FROM (SELECT user_id, chunk_id, any_value(dl) dl FROM rtf GROUP BY ALL) GROUP BY 1")
CTE["ridf0"] = (["rtf", "rcs"], """SELECT user_id, token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) idf
   FROM rtf JOIN rcs USING (user_id) GROUP BY ALL""")
CTE["ridf"] = (["ridf0"], "SELECT user_id, token, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY user_id) ELSE idf END idf FROM ridf0")
CTE["rbm"] = (["ridf", "rtf", "rcs", "qt", "queries"], """SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) raw
   FROM qt JOIN queries USING (query_id) JOIN ridf USING (user_id, token) JOIN rtf USING (user_id, token) JOIN rcs USING (user_id) GROUP BY ALL HAVING raw > 0""")
CTE["rcos"] = (["reach", "cos", "queries"], """SELECT query_id, chunk_id, similarity sim FROM cos JOIN queries USING (query_id)
   JOIN reach r ON r.user_id = queries.user_id AND r.doc_id = chunk_id""")
CTE["rfused"] = (["rcos", "rbm"], fused_sql("rcos rbm", 20))


@register("scoped_search", sql("rfused", """SELECT query_id, chunk_id, rank::INT AS rank, rrf_score, score, sources FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) - 1 rank FROM rfused) WHERE rank < 5"""))
def scoped_search(spark, sf):
    """Hybrid search where each user's branch and viewable documents are the whole corpus."""
    persons, scopes = scope_tables(spark, sf)
    return scp.scoped_search(*scoped_parts(spark, sf), persons, scopes).select(
        "query_id", "chunk_id", "rank", "rrf_score", "score", "sources")


@register("scoped_keywords", sql("rbm", """SELECT query_id, chunk_id, rank::INT AS rank, round(raw, 4) raw_score FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) - 1 rank FROM rbm) WHERE rank < 20"""))
def scoped_keywords(spark, sf):
    """Keyword scores with document frequencies, length and mean idf of exactly the user's scope."""
    persons, scopes = scope_tables(spark, sf)
    chunks, _, queries, _ = scoped_parts(spark, sf)
    return scp.ranked_bm25(scp.scoped_bm25(chunks, queries, persons, scopes)).select(
        "query_id", "chunk_id", "rank", F.round("raw_score", 4).alias("raw_score"))


@register("scoped_vectors", sql("rcos", """SELECT query_id, chunk_id, rank::INT AS rank, round(sim, 4) similarity FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) - 1 rank FROM rcos) WHERE rank < 20"""))
def scoped_vectors(spark, sf):
    """Cosine top-k over the vectors in the user's scope."""
    persons, scopes = scope_tables(spark, sf)
    _, vecs, _, asked = scoped_parts(spark, sf)
    return scp.scoped_cosine(vecs, asked, persons, scopes).select(
        "query_id", "chunk_id", "rank", F.round("similarity", 4).alias("similarity"))


@register("sensitivity_gate", sql("queries chunk_index scored profiles", """
SELECT query_id, count(*) n_kept, sum(chunk_id)::BIGINT id_sum FROM scored JOIN queries USING (query_id) JOIN chunk_index USING (chunk_id)
LEFT JOIN profiles USING (user_id) WHERE sensitivity <= coalesce(max_clearance, 1) GROUP BY 1"""))
def sensitivity_gate(spark, sf):
    chunks, vecs, queries, qv = search_parts(spark, sf)
    fused = rt.fuse(rt.cosine_top(vecs, qv), rt.bm25_top(chunks, queries))
    profile = ac.profiles(fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf))
    rows = fused.join(queries.select("query_id", "user_id"), "query_id").join(
        chunks.select("chunk_id", "sensitivity"), "chunk_id").join(profile, "user_id", "left")
    return rows.where(F.col("sensitivity") <= F.coalesce("max_clearance", F.lit(1))).groupBy("query_id").agg(
        F.count("*").alias("n_kept"), F.sum("chunk_id").alias("id_sum"))


# The mode is part of the query's number, so that all modes pass the gate in one go.
CTE["mode_scored"] = (["scored"], f"""SELECT query_id * 3 + m query_id, chunk_id, score, CASE m WHEN 0 THEN rrf_score WHEN 1 THEN {SIM} ELSE greatest(0, 1 - lexical_distance) END rrf_score
   FROM scored, (SELECT unnest(range(3)) m) WHERE m = 0 OR (m = 1 AND semantic_distance IS NOT NULL) OR (m = 2 AND lexical_distance IS NOT NULL)""")
CTE["mode_queries"] = (["queries"], "SELECT query_id * 3 + m query_id, user_id FROM queries, (SELECT unnest(range(3)) m)")
CTE["mode_gated"] = (["mode_scored", "mode_queries", "chunk_index", "profiles", "viewable", "grants"],
                     CTE["gated"][1].replace("FROM scored s", "FROM mode_scored s").replace("JOIN queries q", "JOIN mode_queries q"))


@register("gated_search_modes", sql("mode_gated", """SELECT (['hybrid', 'semantic', 'keyword'])[query_id % 3 + 1] AS mode, query_id // 3 query_id, chunk_id, rank::INT AS rank, doc_restricted, chunk_blurred FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) - 1 rank FROM mode_gated) WHERE rank < 5"""))
def gated_search_modes(spark, sf):
    """The gate behind each mode of ranking; candidates of all modes are checked together."""
    chunks, vecs, queries, qv = search_parts(spark, sf)
    semantic, lexical = rt.cosine_top(vecs, qv), rt.bm25_top(chunks, queries)
    modes, out = ("hybrid", "semantic", "keyword"), None
    for number, mode in enumerate(modes):
        rows = rt.with_scores(rt.by_mode(semantic, lexical, mode)).withColumn("query_id", F.col("query_id") * 3 + number)
        out = rows if out is None else out.unionByName(rows)
    asked = queries.select(F.explode(F.array(*[F.col("query_id") * 3 + n for n in range(3)])).alias("query_id"), "user_id")
    rows = top_k(gated_rows(spark, sf, asked, out), ["query_id"], rt.fused_order(), 5)
    return rows.select(
        F.element_at(F.array(*map(F.lit, modes)), (F.col("query_id") % 3).cast("int") + 1).alias("mode"),
        F.expr("query_id div 3").alias("query_id"), "chunk_id", "rank", "doc_restricted", "chunk_blurred")


@register("content_gate", sql("scored queries profiles annotated", f"""
WITH l AS (SELECT doc_id chunk_id, CASE WHEN doc_id % 7 BETWEEN 1 AND 5 AND doc_id % 2 = 0 THEN doc_id % 7 ELSE CASE {LEVELS_SQL} ELSE 1 END END "level" FROM annotated)
SELECT query_id, chunk_id, "level"::INT "level" FROM scored JOIN queries USING (query_id) JOIN l USING (chunk_id) LEFT JOIN profiles USING (user_id) WHERE "level" <= coalesce(max_clearance, 1)"""))
def content_gate(spark, sf):
    """The gate by each candidate's own level: the stored one where it is valid, else what its text says."""
    _, vecs, queries, qv = search_parts(spark, sf)
    fused = rt.fuse(rt.cosine_top(vecs, qv), rt.bm25_top(chunk_index(spark, sf), queries)).select("query_id", "chunk_id")
    stored = F.expr("CASE WHEN doc_id % 2 = 0 THEN cast(doc_id % 7 as string) WHEN doc_id % 3 = 0 THEN 'x' END")
    found = fused.join(queries.select("query_id", "user_id"), "query_id").join(
        fx.annotated(spark, sf).select(F.col("doc_id").alias("chunk_id"), stored.alias("stored"), "text"), "chunk_id")
    profile = ac.profiles(fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf))
    return ac.content_gate(found, profile, "stored", "text").select("query_id", "chunk_id", "level")


@register("normalized_results", sql("scored", """
WITH s AS (SELECT query_id, chunk_id, CASE WHEN chunk_id % 11 = 0 THEN NULL ELSE score END score FROM scored WHERE chunk_id % 9 <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) r FROM s WHERE score IS NULL OR score >= 0.9),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) r FROM s WHERE query_id NOT IN (SELECT query_id FROM p))
SELECT query_id, chunk_id, (r - 1)::INT AS rank, coalesce(score, -1) score FROM (SELECT * FROM p WHERE r <= 5 UNION ALL SELECT * FROM l WHERE r = 1)"""))
def normalized_results(spark, sf):
    """Blank texts out, missing scores last, the best one kept when all are too low."""
    chunks, vecs, queries, qv = search_parts(spark, sf)
    scored = rt.with_scores(rt.fuse(rt.cosine_top(vecs, qv), rt.bm25_top(chunks, queries)))
    rows = scored.select(
        "query_id", "chunk_id", F.when(F.col("chunk_id") % 11 != 0, F.col("score")).alias("score"),
        F.when(F.col("chunk_id") % 9 == 0, " \n").otherwise("text").alias("document_text"))
    return rt.normalize_retrieved(rows, minimum=0.9).select(
        "query_id", "chunk_id", "rank", F.coalesce("score", F.lit(-1.0)).alias("score"))
