"""Table upkeep, mail, files, jobs and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import scoring as sc
from sievegate.functions import text as tx
from sievegate.operators import chunking as ch
from sievegate.operators import conversation as cv
from sievegate.operators import maintenance as mt
from sievegate.operators import retrieval as rt
from sievegate.plans import fixtures as fx
from sievegate.plans.corpus import BLANKS, PACK, sql_html, sql_normalize
from sievegate.plans.fixtures import CTE, sql
from sievegate.plans.registry import register
from sievegate.session import shared_dir
from sievegate.sources import files as fl
from sievegate.sources import mail as ml
from sievegate.sources.sinks import append_log, delete_in_place, replace_partitions, with_partition, write_texts
from sievegate.sources.tables import rows_table, table, text_table
from sievegate.streaming import ingest as ig
from sievegate.streaming import state as st


# ---- listings and counts -----------------------------------------------------------

@register("pending_reviews", sql("docs", "SELECT count_if(status = 'review') n_review, count(*) n_total FROM docs"))
def pending_reviews(spark, sf):
    return fx.documents(spark, sf).agg(F.count_if(F.col("status") == "review").alias("n_review"), F.count("*").alias("n_total"))


@register("version_numbers", sql("docs versions", """SELECT d.doc_id, coalesce(max(version_no), 0)::INT max_version_no, count(version_no) version_count FROM docs d LEFT JOIN versions v ON v.doc_id = d.doc_id GROUP BY 1"""))
def version_numbers(spark, sf):
    return mt.version_numbers(fx.documents(spark, sf), fx.versions(spark, sf))


@register("document_types", sql("docs versions", """SELECT d.doc_id, CASE WHEN document_type = 'general' AND file_name IS NOT NULL THEN lower(split_part(file_name, '.', 2)) ELSE document_type END document_type
  FROM docs d LEFT JOIN (SELECT doc_id, arg_max(file_name, version_no) file_name FROM versions GROUP BY 1) v ON v.doc_id = d.doc_id"""))
def document_types(spark, sf):
    return mt.document_types(fx.documents(spark, sf), mt.current_versions(fx.versions(spark, sf)))


@register("jobs_listing", sql("jobs docs versions", """SELECT job_id, j.status, coalesce(title, 'none') title, coalesce(version_no, 0) version_no FROM (SELECT * FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 200) j
  LEFT JOIN docs d ON d.doc_id = j.doc_id LEFT JOIN versions v ON v.version_id = j.version_id"""))
def jobs_listing(spark, sf):
    out = mt.jobs_listing(fx.jobs(spark, sf), fx.documents(spark, sf), fx.versions(spark, sf))
    return out.select("job_id", "status", F.coalesce("title", F.lit("none")).alias("title"), F.coalesce("version_no", F.lit(0)).alias("version_no"))


@register("trace_listing", """SELECT event_id trace_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') created, round("value" * 10)::BIGINT total_ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""")
def trace_listing(spark, sf):
    newest = cv.latest(table(spark, sf, "events"), [F.col("ts").desc(), F.col("event_id").desc()])
    return newest.select(F.col("event_id").alias("trace_id"), "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
                         F.round(F.col("value") * 10).cast("long").alias("total_ms"))


@register("latest_pending_jobs", sql("jobs", "SELECT doc_id, arg_max(job_id, (created_at, job_id)) job_id FROM jobs WHERE status = 'pending_approval' GROUP BY 1"))
def latest_pending_jobs(spark, sf):
    return mt.latest_pending(fx.jobs(spark, sf)).select("doc_id", "job_id")


@register("job_step_times", """SELECT job_id, string_agg(step, '>' ORDER BY s) steps, sum(e - s)::BIGINT total_ms, max(e - s) longest_ms FROM (
  SELECT event_id // 3 job_id, (['parse', 'chunk', 'embed', 'index'])[event_id % 4 + 1] step, epoch_ms(ts) s, epoch_ms(ts) + event_id % 1000 e FROM events) GROUP BY 1""")
def job_step_times(spark, sf):
    steps = table(spark, sf, "events").selectExpr(
        "event_id div 3 job_id", "element_at(array('parse', 'chunk', 'embed', 'index'), cast(event_id % 4 as int) + 1) step_name",
        "unix_millis(to_timestamp(cast(ts as string))) started_ms",
        "unix_millis(to_timestamp(cast(ts as string))) + event_id % 1000 ended_ms")
    return mt.job_steps(steps)


@register("settings", """WITH w AS (SELECT (['rag.top_k', 'rag.similarity_threshold', 'other', 'query_scope_mode'])[event_id % 4 + 1] setting,
    (['"branch_only"', '7', '0.25', '1'])[(event_id + 1) % 4 + 1] v, ts, event_id FROM events WHERE event_id % 4 <> 1),
  l AS (SELECT setting, arg_max(CASE setting WHEN 'rag.top_k' THEN (event_id % 20)::VARCHAR WHEN 'query_scope_mode' THEN 'branch_only' ELSE 'x' END, (ts, event_id)) v FROM w GROUP BY 1)
  SELECT d.setting, coalesce(l.v, d.v) AS "value" FROM (VALUES ('rag.top_k', '5'), ('rag.similarity_threshold', '0.0'), ('rag.hybrid_search', 'true'), ('query_scope_mode', 'full_db')) d(setting, v) LEFT JOIN l ON l.setting = d.setting""")
def settings(spark, sf):
    """Last write per key over the defaults; unknown keys are refused."""
    writes = table(spark, sf, "events").where("event_id % 4 <> 1").selectExpr(
        "element_at(array('rag.top_k', 'rag.similarity_threshold', 'other', 'query_scope_mode'), cast(event_id % 4 as int) + 1) setting",
        "event_id", "ts").withColumn("value", F.expr(
            "CASE setting WHEN 'rag.top_k' THEN cast(event_id % 20 as string) WHEN 'query_scope_mode' THEN '\"branch_only\"' ELSE 'x' END"))
    stored = writes.groupBy("setting").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return mt.merged_settings(rows_table(spark, "setting string, value string", fixed.SETTING_DEFAULTS), stored)


@register("ordered_versions", sql("versions", "SELECT doc_id, version_id, row_number() OVER (PARTITION BY doc_id ORDER BY version_no) - 1 AS place FROM versions"))
def ordered_versions(spark, sf):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("version_no")) - 1
    return fx.versions(spark, sf).select("doc_id", "version_id", place.alias("place"))


def listings(spark, sf):
    """listing -> rows with scope, key and what they are ordered by."""
    rules = fx.rules(spark, sf).selectExpr("coalesce(domain_code, '') scope", "rule_code key", "priority")
    requests = fx.access_requests(spark, sf).selectExpr("cast(user_id as string) scope", "cast(request_id as string) key", "created_at", "request_id")
    docs = table(spark, sf, "documents").selectExpr("'' scope", "cast(doc_id as string) key", "doc_id", "doc_id * 7919 % 1009 updated")
    return {
        "domains": (fx.domains(spark, sf).selectExpr("'' scope", "domain_code key"), [F.col("key")]),
        "entity_types": (fx.domain_types(spark, sf).selectExpr("domain_code scope", "entity_type key"), [F.col("key")]),
        "rules": (rules, [F.col("priority").desc(), F.col("key")]),
        "versions": (fx.versions(spark, sf).selectExpr("cast(doc_id as string) scope", "version_id key", "version_no"), [F.col("version_no")]),
        "documents": (docs, [F.col("updated").desc(), F.col("doc_id")]),
        "users": (fx.users(spark, sf).selectExpr("'' scope", "cast(user_id as string) key", "user_name", "user_id"), [F.col("user_name"), F.col("user_id")]),
        "pages": (fx.pages(spark, sf).selectExpr("cast(doc_id as string) scope", "cast(page_no as string) key", "page_no"), [F.col("page_no")]),
        "requests": (requests, [F.col("created_at").desc(), F.col("request_id").desc()]),
        "all_requests": (requests.withColumn("scope", F.lit("")), [F.col("created_at").desc(), F.col("request_id").desc()]),
    }


@register("ordered_listings", sql("domains domain_types rules versions users doc_pages requests", """
WITH l AS (SELECT 'domains' listing, '' scope, domain_code k, row_number() OVER (ORDER BY domain_code) place FROM domains
   UNION ALL SELECT 'entity_types', domain_code, entity_type, row_number() OVER (PARTITION BY domain_code ORDER BY entity_type) FROM domain_types
   UNION ALL SELECT 'rules', coalesce(domain_code, ''), rule_code, row_number() OVER (PARTITION BY coalesce(domain_code, '') ORDER BY priority DESC, rule_code) FROM rules
   UNION ALL SELECT 'versions', doc_id::VARCHAR, version_id, row_number() OVER (PARTITION BY doc_id ORDER BY version_no) FROM versions
   UNION ALL SELECT 'documents', '', doc_id::VARCHAR, row_number() OVER (ORDER BY doc_id * 7919 % 1009 DESC, doc_id) FROM documents
   UNION ALL SELECT 'users', '', user_id::VARCHAR, row_number() OVER (ORDER BY user_name, user_id) FROM users
   UNION ALL SELECT 'pages', doc_id::VARCHAR, page_no::VARCHAR, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) FROM doc_pages
   UNION ALL SELECT 'requests', user_id::VARCHAR, request_id::VARCHAR, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, request_id DESC) FROM requests
   UNION ALL SELECT 'all_requests', '', request_id::VARCHAR, row_number() OVER (ORDER BY created_at DESC, request_id DESC) FROM requests)
SELECT listing, scope, k AS item, place - 1 place FROM l"""))
def ordered_listings(spark, sf):
    """Every listed order, with the place of each row in its list."""
    out = None
    for name, (rows, order) in listings(spark, sf).items():
        part = mt.ordered_places(rows, [F.col("scope")], order).select(
            F.lit(name).alias("listing"), "scope", F.col("key").alias("item"), "place")
        out = part if out is None else out.unionByName(part)
    return out


@register("clipped_inputs", """SELECT doc_id, sha256(text[1:2000]) trace_hash, sha256(text[1:800]) classifier_hash FROM documents""")
def clipped_inputs(spark, sf):
    """What a trace and the domain classifier keep of a text: their own limits."""
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(F.substring("text", 1, fixed.TRACE_CHARS), 256).alias("trace_hash"),
        F.sha2(F.substring("text", 1, fixed.CLASSIFIER_CHARS), 256).alias("classifier_hash"))


@register("open_conversations", """SELECT conv_id, conv_id % 150 user_id, max(turn) last_turn FROM conversations WHERE conv_id % 4 <> 0 GROUP BY 1""")
def open_conversations(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).withColumn(
        "status", F.when(F.col("conv_id") % 4 == 0, "closed").otherwise("open"))
    return rows.where("status = 'open'").select("conv_id", (F.col("conv_id") % 150).alias("user_id"), "last_turn")


@register("numeric_scores", """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN "value" ELSE event_id * 1.0 END, -1)::DOUBLE score FROM events""")
def numeric_scores(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN cast(value as string) END score", "cast(event_id as string) relevance")
    return rows.select("event_id", F.coalesce(sc.numeric_score(F.col("score"), F.col("relevance")), F.lit(-1.0)).alias("score"))


# ---- table upkeep ---------------------------------------------------------------------

def base_rows(spark, sf):
    return table(spark, sf, "documents").selectExpr("concat('k', doc_id) chunk_id", "doc_id", "n_chars amount", "0 batch")


CTE["base"] = ([], "SELECT 'k' || doc_id chunk_id, doc_id, n_chars amount, 0 batch FROM documents")


@register("upsert_latest", sql("base", """WITH u AS (SELECT 'k' || (event_id % 2000) chunk_id, event_id % 2000 doc_id, event_id amount, (event_id // 2000)::INT batch FROM events)
SELECT chunk_id, doc_id, amount, batch FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY batch DESC) = 1
UNION ALL SELECT * FROM base WHERE chunk_id NOT IN (SELECT chunk_id FROM u)"""))
def upsert_latest(spark, sf):
    changes = table(spark, sf, "events").selectExpr(
        "concat('k', event_id % 2000) chunk_id", "event_id % 2000 doc_id", "event_id amount", "cast(event_id div 2000 as int) batch")
    return mt.upsert_latest(base_rows(spark, sf), changes, "chunk_id", [F.col("batch").desc()])


@register("delete_rows", sql("base", "SELECT chunk_id, amount FROM base WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND chunk_id NOT LIKE 'k1%'"))
def delete_rows(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return mt.delete_prefix(mt.delete_keys(base_rows(spark, sf), gone, "doc_id"), "chunk_id", "k1").select("chunk_id", "amount")


@register("rows_of_keys", sql("base", "SELECT chunk_id, amount FROM base WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def rows_of_keys(spark, sf):
    return mt.rows_of_keys(base_rows(spark, sf), table(spark, sf, "labels").where("quality = 1"), "doc_id").select("chunk_id", "amount")


@register("cascade_delete", sql("versions jobs doc_nodes", """WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1), v AS (SELECT version_id FROM versions WHERE doc_id IN (SELECT doc_id FROM g))
SELECT 'documents' AS table_name, count(*) n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'versions', count(*) FROM versions WHERE doc_id NOT IN (SELECT doc_id FROM g)
UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE version_id NOT IN (SELECT version_id FROM v) UNION ALL SELECT 'nodes', count(*) FROM doc_nodes WHERE doc_id NOT IN (SELECT doc_id FROM g)"""))
def cascade_delete(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    versions = fx.versions(spark, sf)
    left = mt.cascade_delete(
        {"documents": (fx.documents(spark, sf), "doc_id"), "versions": (versions, "doc_id"),
         "jobs": (fx.jobs(spark, sf), "version_id"), "nodes": (fx.document_nodes(spark, sf), "doc_id")},
        {"doc_id": gone, "version_id": versions.join(gone, "doc_id", "left_semi").select("version_id")})
    out = None
    for name, rows in left.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


CTE["linked"] = (["versions", "jobs", "docs"], """SELECT 'documents' t, doc_id, doc_id k FROM docs
  UNION ALL SELECT 'versions', doc_id, doc_id * 10 + version_no FROM versions UNION ALL SELECT 'snapshots', doc_id, doc_id * 10 + version_no FROM versions
  UNION ALL SELECT 'chunks', doc_id, (doc_id * 10 + version_no) * 10 + c FROM versions, (SELECT unnest(range(2)) c)
  UNION ALL SELECT 'vectors', doc_id, (doc_id * 10 + version_no) * 10 + c FROM versions, (SELECT unnest(range(2)) c)
  UNION ALL SELECT 'jobs', doc_id, job_id FROM jobs UNION ALL SELECT 'steps', doc_id, job_id * 10 + s FROM jobs, (SELECT unnest(range(3)) s)
  UNION ALL SELECT 'tuples', doc_id, doc_id FROM docs""")


def linked_tables(spark, sf):
    """Documents and all that hangs on them, each row with its key k and the key of what it hangs on."""
    versions = fx.versions(spark, sf).selectExpr("doc_id * 10 + version_no k", "doc_id")
    chunks = versions.selectExpr("explode(sequence(0, 1)) c", "k version").selectExpr("version * 10 + c k", "version")
    jobs = fx.jobs(spark, sf).selectExpr("job_id k", "doc_id")
    tables = {
        "documents": fx.documents(spark, sf).selectExpr("doc_id k"), "versions": versions,
        "snapshots": versions.selectExpr("k", "k version"), "chunks": chunks, "vectors": chunks.selectExpr("k", "k chunk"), "jobs": jobs,
        "steps": jobs.selectExpr("explode(sequence(0, 2)) s", "k job").selectExpr("job * 10 + s k", "job"),
        "tuples": fx.documents(spark, sf).selectExpr("doc_id k", "doc_id")}
    links = [
        ("tuples", "doc_id", "documents", "k"), ("versions", "doc_id", "documents", "k"), ("chunks", "version", "versions", "k"),
        ("vectors", "chunk", "chunks", "k"), ("snapshots", "version", "versions", "k"), ("jobs", "doc_id", "documents", "k"),
        ("steps", "job", "jobs", "k")]
    return tables, links


@register("cascade_tables", sql("linked", """SELECT t table_name, count(*) n, sum(k)::BIGINT key_sum FROM linked
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1"""))
def cascade_tables(spark, sf):
    """Deletion through the graph of tables, each rewritten only in the partitions that hold its lost keys."""
    tables, links = linked_tables(spark, sf)
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("k"))
    lost, out = mt.cascade_graph(tables, links, "documents", gone), None
    for name, rows in tables.items():
        path = run_dir(spark, f"table-{name}")
        replace_partitions(with_partition(rows, "k", 16), path, ["part"])
        delete_in_place(spark, path, lost[name], "k", 16)
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum")).select(
            F.lit(name).alias("table_name"), "n", "key_sum")
        out = part if out is None else out.unionByName(part)
    return out


@register("object_upsert", """SELECT 'raw' bucket, 'doc/' || doc_id object_key, octet_length(encode(text)) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END size_bytes,
   sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) checksum, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END put FROM documents""")
def object_upsert(spark, sf):
    """The registry after a second put of every third object, and a put of the same bytes of others."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("object_key"), "doc_id", "text")
    rows = lambda objects, put: mt.registry_rows(objects.withColumn(
        "content", F.encode("text", "utf-8")), "raw").withColumn("put", F.lit(put))
    again = docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!")))
    changes = rows(again, 2).unionByName(rows(again.withColumn("text", F.lit("an earlier put")), 1))
    return mt.upsert_latest(rows(docs, 1), changes, "object_key", [F.col("put").desc()])


@register("metadata_update", """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN '4' ELSE (doc_id % 5)::VARCHAR END sensitivity, lang,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'blank' ELSE 'absent' END note FROM documents""")
def metadata_update(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", mt.flatten_metadata(
        {"sensitivity": F.col("doc_id") % 5, "lang": F.col("lang"), "nothing": F.lit(None)},
        {"parts": F.array(F.lit(1), F.lit(2))}).alias("metadata"))
    out = mt.update_metadata(rows, table(spark, sf, "labels"), "doc_id", {"sensitivity": "4", "note": None})
    note = F.try_element_at(F.col("metadata"), F.lit("note"))
    return out.select("doc_id", F.col("metadata")["sensitivity"].alias("sensitivity"), F.col("metadata")["lang"].alias("lang"),
                      F.when(note == "", "blank").otherwise("absent").alias("note"))


@register("metadata_flatten", """SELECT doc_id, 'lang=' || lang || ';' || CASE WHEN doc_id % 2 = 0 THEN 'n=' || n_chars || ';' ELSE '' END || 'parts=[' || doc_id || ',1]' flat FROM documents""")
def metadata_flatten(spark, sf):
    flat = mt.flatten_metadata({"lang": F.col("lang"), "n": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))},
                               {"parts": F.array(F.col("doc_id"), F.lit(1))})
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(
        F.map_entries(flat), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("flat"))


@register("patch_rows", sql("docs", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || doc_id ELSE title END title, CASE WHEN doc_id % 6 = 0 THEN 5 ELSE sensitivity END::INT sensitivity, status FROM docs"""))
def patch_rows(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "title", "sensitivity", "status")
    patch = table(spark, sf, "documents").where("doc_id % 3 = 0").selectExpr(
        "doc_id", "concat('new ', doc_id) title", "CASE WHEN doc_id % 6 = 0 THEN 5 END sensitivity")
    return mt.patch_rows(docs, patch, "doc_id")


@register("object_registry", """SELECT 'raw' bucket, 'doc/' || doc_id object_key, octet_length(encode(text)) size_bytes, sha256(text) checksum FROM documents""")
def object_registry(spark, sf):
    objects = table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("object_key"), F.encode("text", "utf-8").alias("content"))
    return mt.registry_rows(objects, "raw")


@register("audit_rows", """SELECT user_id, 'doc.' || event_type act, event_id resource_id, decision, sha256('{"value":' || v || ',"k":' || event_id || '}') json_hash FROM (
  SELECT *, CASE WHEN event_id % 4 = 0 THEN 'deny' ELSE 'allow' END decision, round("value")::INT v FROM events)""")
def audit_rows(spark, sf):
    actions = table(spark, sf, "events").selectExpr(
        "user_id", "concat('doc.', event_type) action", "event_id resource_id", "ts created_at",
        "CASE WHEN event_id % 4 = 0 THEN 'deny' ELSE 'allow' END decision", "cast(round(value) as int) value", "event_id k")
    return mt.audit_rows(actions, ["value", "k"]).select(
        "user_id", F.col("action").alias("act"), "resource_id", "decision", F.sha2("output_json", 256).alias("json_hash"))


@register("job_requests", """SELECT idempotency_key, min(event_id) request_id FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'ingest:v' || (event_id % 400) || ':' || event_id ELSE 'ingest:v' || (event_id % 400) END idempotency_key FROM events)
  WHERE idempotency_key NOT IN (SELECT 'ingest:v' || doc_id FROM labels) GROUP BY 1""")
def job_requests(spark, sf):
    requests = table(spark, sf, "events").selectExpr(
        "event_id request_id", "concat('v', event_id % 400) version_id", "event_id % 10 = 0 force_new", "ts created_at")
    existing = table(spark, sf, "labels").selectExpr("concat('ingest:v', doc_id) idempotency_key")
    return mt.idempotent_jobs(requests, existing).select("idempotency_key", "request_id")


def job_events(spark, sf):
    names = "array('queue', 'start', 'fail', 'retry', 'start', 'succeed', 'cancel')"
    return table(spark, sf, "events").selectExpr(
        "event_id % 700 job_id", "event_id", "ts created_at", f"element_at({names}, cast((event_id div 700) * 5 % 7 as int) + 1) event")


CTE["job_events"] = ([], """SELECT event_id % 700 job_id, event_id, (['queue', 'start', 'fail', 'retry', 'start', 'succeed', 'cancel'])[(event_id // 700) * 5 % 7 + 1] ev,
   row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts, event_id) i FROM events""")
CTE["job_fold"] = (["job_events"], """SELECT DISTINCT job_id, 0::BIGINT i, 'new' st, 0 retries FROM job_events UNION ALL
   SELECT e.job_id, e.i, CASE WHEN ev = 'queue' AND st IN ('new', 'pending_approval') THEN 'queued' WHEN ev = 'start' AND st = 'queued' THEN 'running' WHEN ev = 'succeed' AND st = 'running' THEN 'succeeded'
     WHEN ev = 'fail' AND st = 'running' THEN 'failed' WHEN ev = 'cancel' AND st IN ('queued', 'running') THEN 'failed' WHEN ev = 'retry' AND st = 'failed' THEN 'queued' ELSE st END,
     CASE WHEN ev = 'retry' AND st = 'failed' THEN retries + 1 ELSE retries END FROM job_fold f JOIN job_events e ON e.job_id = f.job_id AND e.i = f.i + 1""")
JOB_SQL = "SELECT job_id, st status, retries FROM job_fold QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1"


@register("job_lifecycle", sql("job_fold", JOB_SQL))
def job_lifecycle(spark, sf):
    return mt.fold_jobs(job_events(spark, sf)).drop("n_events")


@register("ingest_metrics", sql("", f"""SELECT lang, count(*) n_documents, count_if(trim(text, {BLANKS}) = '') n_failed, sum(n_chars)::BIGINT n_chars FROM documents GROUP BY 1"""))
def ingest_metrics(spark, sf):
    """Chunking of every document with step figures; documents without a chunk are failures."""
    docs = text_table(spark, sf, "documents")
    chunks = ch.chunk_documents(docs, PACK).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    rows = docs.select("doc_id", "lang", "n_chars").join(chunks, "doc_id", "left")
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("n_chunks").isNull()).alias("n_failed"), F.sum("n_chars").alias("n_chars"))


# ---- mail and files ---------------------------------------------------------------------

def mail_tables(spark, sf):
    pages = text_table(spark, sf, "pages")
    url64 = "rtrim('=', translate(base64(encode({}, 'utf-8')), '+/\\n\\r', '-_'))"
    html = pages.selectExpr("page_id message_id", "'1.2' part_path", "'text/html' mime_type", url64.format("html") + " data")
    plain = pages.where("page_id % 2 = 0").selectExpr(
        "page_id message_id", "'1.1' part_path", "'text/plain' mime_type",
        url64.format("CASE WHEN page_id % 4 = 0 THEN concat('Plain é ', url) ELSE '<p>x' END") + " data")
    later = pages.where("page_id % 2 = 0").selectExpr(
        "page_id message_id", "'2.1' part_path", "'text/plain' mime_type", url64.format("'later'") + " data")
    messages = pages.selectExpr(
        "page_id message_id", "page_id % 5 user_id", "concat('snip ', page_id) snippet",
        "array(named_struct('name', 'FROM', 'value', concat('u', page_id % 9)), named_struct('name', 'subject', 'value', url)) headers")
    return messages, html.unionByName(plain).unionByName(later)


MAIL_BODY = f"CASE WHEN page_id % 4 = 0 THEN 'Plain é ' || url ELSE {sql_html('html')} END"


@register("mail_bodies", f"SELECT page_id message_id, CASE WHEN page_id % 4 = 0 THEN 'Plain é ' || url ELSE '<p>x' END plain, sha256(html) html_hash FROM pages WHERE page_id % 2 = 0")
def mail_bodies(spark, sf):
    _, parts = mail_tables(spark, sf)
    plain, html = ml.first_part(parts, "text/plain", "plain"), ml.first_part(parts, "text/html", "html")
    return plain.join(html, "message_id").select("message_id", "plain", F.sha2("html", 256).alias("html_hash"))


@register("mail_headers", "SELECT page_id message_id, url subject, 'u' || (page_id % 9) sender, '' AS sent FROM pages")
def mail_headers(spark, sf):
    messages, _ = mail_tables(spark, sf)
    h = F.col("headers")
    return messages.select("message_id", ml.header(h, "Subject").alias("subject"), ml.header(h, "From").alias("sender"), ml.header(h, "Date").alias("sent"))


@register("mail_documents", f"""SELECT page_id message_id, url subject, sha256(trim('Subject: ' || url || chr(10) || 'From: u' || (page_id % 9) || chr(10) || 'Date: ' || chr(10) || chr(10)
  || coalesce(nullif({MAIL_BODY}, ''), 'snip ' || page_id), {BLANKS})) text_hash FROM pages""")
def mail_documents(spark, sf):
    messages, parts = mail_tables(spark, sf)
    return ml.mail_documents(messages, parts).select("message_id", "subject", F.sha2("text", 256).alias("text_hash"))


@register("mail_sync", "SELECT page_id % 5 user_id, count_if(page_id % 3 <> 0) synced, count_if(page_id % 3 = 0) skipped FROM pages GROUP BY 1")
def mail_sync(spark, sf):
    messages, _ = mail_tables(spark, sf)
    ledger = messages.where("message_id % 3 = 0").select("user_id", "message_id")
    return ml.sync_counts(messages, ledger, ["user_id", "message_id"], "user_id")


@register("mail_synced_flags", "SELECT page_id message_id, page_id % 3 = 0 synced FROM pages")
def mail_synced_flags(spark, sf):
    messages, _ = mail_tables(spark, sf)
    ledger = messages.where("message_id % 3 = 0").select("user_id", "message_id")
    return ml.synced_flags(messages, ledger, ["user_id", "message_id"]).select("message_id", "synced")


@register("parsed_files", f"""SELECT doc_id, (['text', 'text', 'pdf', 'docx', 'image', 'text'])[doc_id % 6 + 1] kind, CASE WHEN doc_id % 6 IN (2, 3, 4) THEN 'needs_reader' ELSE 'ok' END outcome FROM documents WHERE trim(text, {BLANKS}) <> ''""")
def parsed_files(spark, sf):
    """Bytes with damaged characters, routed by extension and MIME type."""
    files = text_table(spark, sf, "documents").select(
        "doc_id", F.expr("concat('f', doc_id, element_at(array('.txt', '.MD', '.pdf', '', '.PNG', '.xyz'), cast(doc_id % 6 as int) + 1))").alias("name"),
        F.when(F.col("doc_id") % 6 == 3, "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("").alias("mime"),
        F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF"))).alias("content"))
    good, bad = fl.parse_texts(files, ["doc_id"])
    return good.select("doc_id", "kind", F.lit("ok").alias("outcome")).unionByName(
        bad.select("doc_id", "kind", F.col("reason").alias("outcome")))


# ---- sinks and streams -------------------------------------------------------------------

def run_dir(spark, name: str) -> str:
    """A new folder under the shared one for each run."""
    return f"{shared_dir(spark)}/sievegate-{name}-{uuid.uuid4().hex}"


def document_files(spark, sf):
    """Documents as files in folders by language, with damaged bytes, extensions of all kinds."""
    ends = "array('.txt', '.MD', '.pdf', '.docx', '.PNG', '.xyz')"
    return text_table(spark, sf, "documents").select("doc_id", F.expr(
        f"concat('lang=', coalesce(lang, 'none'), '/f', doc_id, element_at({ends}, cast(doc_id % 6 as int) + 1))").alias("object_key"),
        F.concat(F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.unhex(F.lit("FF"))).alias("content"))


def file_id():
    return F.regexp_extract("name", r"^f(\d+)", 1).cast("long").alias("doc_id")


CTE["files"] = ([], f"""SELECT doc_id, lang, n_bytes, kind, t, CASE WHEN kind <> 'text' THEN 'needs_reader' WHEN t = '' THEN 'no_text' ELSE 'ok' END outcome FROM (
   SELECT doc_id, coalesce(lang, 'none') lang, octet_length(encode(coalesce(text, ''))) + 1 n_bytes, coalesce({sql_normalize('text')}, '') t,
   (['text', 'text', 'pdf', 'docx', 'image', 'text'])[doc_id % 6 + 1] kind FROM documents)""")


@register("stored_files", sql("files", "SELECT doc_id, lang, n_bytes, kind, outcome, CASE WHEN outcome = 'ok' THEN sha256(t) ELSE 'none' END text_hash FROM files"))
def stored_files(spark, sf):
    """Documents written as files, read back as bytes with their folder's language, decoded and normalised."""
    path = run_dir(spark, "objects")
    fl.write_objects(document_files(spark, sf), path)
    files = fl.read_objects(spark, path, "lang string").withColumns({"doc_id": file_id(), "n_bytes": F.col("length")})
    rows = fl.parsed_rows(files, ["doc_id", "lang", "n_bytes"])
    return rows.select("doc_id", "lang", "n_bytes", "kind", "outcome", F.when(
        F.col("outcome") == "ok", F.sha2("text", 256)).otherwise("none").alias("text_hash"))


@register("stream_files", sql("files", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END arrival, lang, kind, outcome, CASE WHEN outcome = 'ok' THEN sha256(t) ELSE 'none' END text_hash FROM files"))
def stream_files(spark, sf):
    """Files arrive twice in one tree; each is parsed once, rejects beside the texts with their reason."""
    path, out, checkpoint = run_dir(spark, "tree"), run_dir(spark, "parsed"), run_dir(spark, "cp")
    files, stream = document_files(spark, sf), None
    for part in ("doc_id % 3 = 0", "doc_id % 3 <> 0"):
        fl.write_objects(files.where(part), path)
        if stream is None:  # the whole tree is listed to know its folders' columns; each run then lists what is there
            stream = fl.stream_objects(spark, path, "lang string", per_trigger=10_000_000).withColumn("doc_id", file_id())
        with fl.small_files(spark):
            ig.run_available(stream, fl.store_parsed(out, ["doc_id", "lang"]), checkpoint)
    return spark.read.parquet(out).select(
        "doc_id", F.col("batch_id").alias("arrival"), "lang", "kind", "outcome",
        F.when(F.col("outcome") == "ok", F.sha2("text", 256)).otherwise("none").alias("text_hash"))


@register("clean_rerun", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END run, n_chars FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)""")
def clean_rerun(spark, sf):
    """A second run of some partitions replaces exactly those partitions."""
    path = run_dir(spark, "rerun")
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 3).alias("part"))
    replace_partitions(rows.withColumn("run", F.lit(1)), path, ["part"])
    replace_partitions(rows.where("part = 0 AND doc_id % 2 = 1").withColumn("run", F.lit(2)), path, ["part"])
    return spark.read.parquet(path).select("doc_id", "run", "n_chars")


@register("outbox_pending", "SELECT event_type, count(*) n FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def outbox_pending(spark, sf):
    """Outbox rows appended in two writes, then read as a stream of queued events."""
    path, out = run_dir(spark, "outbox"), run_dir(spark, "outbox-seen")
    actions = table(spark, sf, "events").selectExpr("event_id resource_id", "ts created_at", "event_type kind", "user_id")
    rows = mt.outbox_rows(actions, "doc.changed", ["kind", "user_id"]).withColumn(
        "status", F.when(F.col("resource_id") % 3 == 0, "sent").otherwise("queued")).drop("resource_id")
    append_log(rows.where("status = 'queued'"), path)
    append_log(rows.where("status = 'sent'"), path)
    stream = st.pending_outbox(spark, path, spark.read.parquet(path).schema)
    ig.run_available(stream, lambda batch, i: replace_partitions(batch.withColumn("b", F.lit(i)), out, ["b"]), run_dir(spark, "cp"))
    return spark.read.parquet(out).groupBy(F.get_json_object("payload", "$.kind").alias("event_type")).agg(F.count("*").alias("n"))


@register("stream_ingest", sql("packed_chunks", """SELECT doc_id, (1 + doc_id % 3)::INT version_no, count(*) n_chunks, sum(token_count)::BIGINT n_tokens
FROM packed_chunks GROUP BY 1"""))
def stream_ingest(spark, sf):
    """Versions arrive as files, some twice, each is chunked once; the latest equal the batch."""
    from sievegate.plans.corpus import heading_text

    source, index = run_dir(spark, "versions"), run_dir(spark, "index")
    docs = heading_text(spark, sf).withColumn("last", (1 + F.col("doc_id") % 3).cast("int")).withColumn(
        "version_no", F.explode(F.sequence(F.lit(1), "last"))).withColumn(
        "text", F.when(F.col("version_no") == F.col("last"), F.col("text")).otherwise(
            F.concat(F.lit("Old words. "), "text"))).drop("last")
    append_log(docs.where("version_no <> 2"), source)
    append_log(docs.where("version_no >= 2 OR doc_id % 5 = 0"), source)
    stream = ig.read_versions(spark, source, docs.schema, files_per_trigger=8)
    ig.run_available(stream, ig.ingest_once(index, PACK), run_dir(spark, "cp"))
    return ig.latest_versions(spark.read.parquet(index)).groupBy("doc_id", "version_no").agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


@register("ingest_run", sql("packed_chunks", f"""
WITH v AS (SELECT doc_id, (['text', 'text', 'pdf', 'docx', 'image', 'text'])[doc_id % 6 + 1] kind, trim(text, {BLANKS}) = '' blank FROM documents),
c AS (SELECT count(*) n, count(DISTINCT p.doc_id) d, sum(token_count) t FROM packed_chunks p JOIN v USING (doc_id) WHERE kind = 'text')
SELECT 'parse' step, count_if(kind = 'text') n_rows, 0::BIGINT tokens FROM v
UNION ALL SELECT 'chunk', n, 0 FROM c UNION ALL SELECT 'embed', n, 0 FROM c UNION ALL SELECT 'index', n, t::BIGINT FROM c
UNION ALL SELECT 'reject', count(*), 0 FROM v WHERE kind <> 'text' OR blank
UNION ALL SELECT 'needs_reader', count(*), 0 FROM v WHERE kind <> 'text' UNION ALL SELECT 'no_text', count(*), 0 FROM v WHERE kind = 'text' AND blank"""))
def ingest_run(spark, sf):
    """Two runs of one batch: figures of its steps, and what its three tables hold after the second."""
    from sievegate.plans.corpus import heading_text

    out = run_dir(spark, "ingest")
    versions = heading_text(spark, sf).select(
        "doc_id", F.lit(1).alias("version_no"),
        F.expr("concat('f', doc_id, element_at(array('.txt', '.MD', '.pdf', '', '.PNG', '.xyz'), cast(doc_id % 6 as int) + 1))").alias("name"),
        F.when(F.col("doc_id") % 6 == 3, "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("").alias("mime"),
        F.encode("text", "utf-8").alias("content"))
    for _ in range(2):
        ig.ingest_run(versions, out, 7, PACK, rt.hashed_encoder())
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    index, rejects = read("index"), read("rejects")
    tokens = index.where("size(embedding) = 64").select(F.sum("token_count")).scalar()
    zero = F.lit(0).cast("long").alias("tokens")
    steps = read("steps").where("duration_ms IS NULL OR duration_ms > 0").select(
        "step", "n_rows", F.when(F.col("step") == "index", tokens).otherwise(F.lit(0)).cast("long").alias("tokens"))
    kinds = rows_table(spark, "step string", [("needs_reader",), ("no_text",)])
    found = rejects.groupBy(F.col("reason").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return steps.unionByName(kinds.join(found, "step", "left").select(
        "step", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), zero))


@register("stream_mail_sync", f"""
WITH m AS (SELECT page_id, page_id % 5 user_id FROM pages),
a AS (SELECT 0 arrival, user_id, count_if(page_id % 3 = 0) synced, 0::BIGINT skipped FROM m WHERE page_id % 3 = 0 GROUP BY ALL
  UNION ALL SELECT 1, user_id, count_if(page_id % 3 <> 0), count_if(page_id % 3 = 0) FROM m GROUP BY ALL
  UNION ALL SELECT 2, user_id, 0, count(*) FROM m WHERE page_id = 6 GROUP BY ALL
  UNION ALL SELECT 3, user_id, count(*), 0 FROM m WHERE page_id % 2 = 0 GROUP BY ALL
  UNION ALL SELECT 4, user_id, count_if(page_id % 2 = 0 AND false), count(*) FROM m WHERE page_id % 4 = 0 GROUP BY ALL)
SELECT arrival::BIGINT arrival, user_id, synced, skipped FROM a""")
def stream_mail_sync(spark, sf):
    """A part of the mailboxes, all of them, one message again, and a listing after the index was lost."""
    from sievegate.streaming.mail_sync import sync_once

    messages, parts = mail_tables(spark, sf)
    listed = ml.mail_documents(messages, parts).join(messages.select("message_id", "user_id"), "message_id").select(
        "user_id", "message_id", "subject", "text").checkpoint()
    source, checkpoint, ledger, counts = (run_dir(spark, n) for n in ("mailboxes", "cp", "mail-ledger", "mail-counts"))
    first, second = run_dir(spark, "mail-index"), run_dir(spark, "mail-index")
    arrivals = ["message_id % 3 = 0", "true", "message_id = 6", "message_id % 2 = 0", "message_id % 4 = 0"]
    for number, part in enumerate(arrivals):
        append_log(listed.where(part).coalesce(4), source)
        stream = spark.readStream.schema(listed.schema).parquet(source)
        # The fourth arrival finds a new, empty index beside the ledger of the old one.
        ig.run_available(stream, sync_once(first if number < 3 else second, ledger, counts), checkpoint)
    return spark.read.parquet(counts).select(F.col("batch_id").cast("long").alias("arrival"), "user_id", "synced", "skipped")


@register("stream_dimension", """
WITH v AS (SELECT n k, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (4 * n2 + n) valid_from, 'v' || n2 || '-' || n label
  FROM (SELECT unnest(range(5)) n), (SELECT unnest(range(6)) n2) WHERE n2 <= n + 1),
s AS (SELECT *, lead(valid_from) OVER (PARTITION BY k ORDER BY valid_from) valid_to FROM v)
SELECT event_id, coalesce(label, 'none') label FROM events LEFT JOIN s ON user_id % 5 = k AND ts >= valid_from AND (valid_to IS NULL OR ts < valid_to)""")
def stream_dimension(spark, sf):
    """Events of all times in two arrivals; late ones meet the version of their own time."""
    source, dimension, out, checkpoint = (run_dir(spark, n) for n in ("dim-events", "dim-versions", "dim-joined", "cp"))
    events = table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).alias("k"), "ts")
    versions = spark.range(30).selectExpr("id % 5 k", "id div 5 n").where("n <= k + 1").selectExpr(
        "k", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(4 * n + k as int)) valid_from", "concat('v', n, '-', k) label", "n")
    versions = versions.withColumn("valid_from", F.col("valid_from").cast(events.schema["ts"].dataType))
    append_log(versions, dimension)
    write = st.with_valid_dimension(
        lambda: spark.read.parquet(dimension).select("k", "valid_from", "label"), ["k"], "ts",
        lambda batch, i: replace_partitions(batch.withColumn("batch_id", F.lit(i)), out, ["batch_id"]))
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        append_log(events.where(part).coalesce(4), source)
        ig.run_available(spark.readStream.schema(events.schema).parquet(source), write, checkpoint)
    return spark.read.parquet(out).select("event_id", F.coalesce("label", F.lit("none")).alias("label"))


@register("written_texts", "SELECT doc_id, sha256(text) text_hash, doc_id % 2 = 0 AS rewritten FROM documents")
def written_texts(spark, sf):
    """Texts in partitions by document; a second write of some documents' partitions replaces whole partitions."""
    path = run_dir(spark, "texts")
    docs = table(spark, sf, "documents").select("doc_id", F.lit(False).alias("rewritten"), "text")
    write_texts(docs, path)
    write_texts(docs.withColumn("rewritten", F.col("doc_id") % 2 == 0), path)
    return spark.read.parquet(path).select("doc_id", F.sha2("text", 256).alias("text_hash"), "rewritten")


@register("embedded_json", """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE CAST(doc_id AS VARCHAR) END id_text, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE lang END lang FROM documents""")
def embedded_json(spark, sf):
    """The JSON object in an answer with words, and line ends, around it; none in every fourth."""
    answers = table(spark, sf, "documents").select("doc_id", F.expr("""CASE WHEN doc_id % 4 = 3 THEN 'No object here.' ELSE concat(
        'Here you are:\n```json\n{"doc": ', doc_id, ', "more": {"x": [1, 2]},\n "lang": ', coalesce(concat('"', lang, '"'), 'null'), '}\n``` Done.') END""").alias("answer"))
    found = answers.withColumn("o", tx.first_json_object("answer"))
    return found.select("doc_id", F.get_json_object("o", "$.doc").alias("id_text"), F.get_json_object("o", "$.lang").alias("lang"))


@register("stream_grants", sql("requests", """SELECT request_id, 'revoked' AS state
FROM requests WHERE status = 'approved' AND request_id % 4 <> 2 AND expires_at < TIMESTAMP '2024-03-01'"""))
def stream_grants(spark, sf):
    """Approvals end by event time; one in four was made endless by a later row and does not."""
    source, out = run_dir(spark, "grant-events"), run_dir(spark, "grant-states")
    rows = fx.access_requests(spark, sf).select(
        "request_id", "status", F.col("created_at").cast("timestamp").alias("created_at"),
        F.col("expires_at").cast("timestamp").alias("expires_at"))
    longer = rows.where("status = 'approved' AND request_id % 4 = 2").withColumns({
        "created_at": F.expr("created_at + INTERVAL 1 SECOND"), "expires_at": F.lit(None).cast("timestamp")})
    clock = rows.limit(1).withColumns({
        "request_id": F.lit(-1).cast(rows.schema["request_id"].dataType), "status": F.lit("pending"),
        "created_at": F.expr("TIMESTAMP '2024-03-01 00:00:00'"), "expires_at": F.lit(None).cast("timestamp")})
    append_log(rows.unionByName(longer), source)
    # All of the first write in one batch, so that the clock's rows come after it.
    first = len(spark.read.schema(rows.schema).parquet(source).inputFiles())
    for part in (clock, clock.withColumn("request_id", F.col("request_id") - 1)):
        append_log(part, source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", first).parquet(source)
    ig.run_available(st.expire_grants(stream), lambda b, i: replace_partitions(
        b.withColumn("batch_id", F.lit(i)), out, ["batch_id"]), run_dir(spark, "cp"))
    return spark.read.parquet(out).where("status = 'revoked'").select("request_id", F.col("status").alias("state"))


@register("stream_jobs", sql("job_fold", JOB_SQL))
def stream_jobs(spark, sf):
    """Job states kept by a stateful stream that stops and resumes from its checkpoint."""
    source, out, checkpoint = run_dir(spark, "job-events"), run_dir(spark, "job-state"), run_dir(spark, "cp")
    events = job_events(spark, sf).select("job_id", "event_id", "event")
    half = table(spark, sf, "events").count() // 2

    def write(batch, batch_id):
        replace_partitions(batch.withColumn("batch_id", F.lit(batch_id)), out, ["batch_id"])

    for part in (F.col("event_id") < half, F.col("event_id") >= half):
        append_log(events.where(part), source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        ig.run_available(st.track_jobs(stream), write, checkpoint, "update")
    return spark.read.parquet(out).groupBy("job_id").agg(
        F.max_by("status", "batch_id").alias("status"), F.max_by("retries", "batch_id").alias("retries"))
