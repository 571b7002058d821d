"""Organisation and access queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.operators import access as ac
from sievegate.plans import fixtures as fx
from sievegate.plans.fixtures import CTE, NOW, sql
from sievegate.plans.registry import register
from sievegate.plans.search import access_inputs, chunk_index
from sievegate.sources.tables import table

NOW_TS = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def all_tuples(spark, sf, pairs, nodes):
    return ac.document_tuples(fx.documents(spark, sf), fx.document_nodes(spark, sf), nodes,
                              fx.node_parents(spark, sf), pairs)


@register("org_closure", sql("closure", "SELECT oui_id, ancestor_id FROM closure"))
def org_closure(spark, sf):
    return ac.closure(fx.node_parents(spark, sf))


@register("org_direct_parents", sql("node_parents", "SELECT oui_id, parent_oui_id FROM node_parents"))
def org_direct_parents(spark, sf):
    return fx.node_parents(spark, sf)


@register("org_roots", sql("roots", "SELECT oui_id, root_id FROM roots"))
def org_roots(spark, sf):
    edges = fx.node_parents(spark, sf)
    return ac.roots(fx.nodes(spark, sf), edges, ac.closure(edges))


@register("org_branches", sql("user_positions closure", """
WITH b AS (SELECT user_id, oui_id FROM user_positions UNION SELECT user_id, ancestor_id FROM user_positions JOIN closure USING (oui_id)
   UNION SELECT user_id, c.oui_id FROM user_positions p JOIN closure c ON c.ancestor_id = p.oui_id)
SELECT user_id, count(*) n_nodes, min(oui_id) first_node FROM b GROUP BY 1"""))
def org_branches(spark, sf):
    pairs = ac.closure(fx.node_parents(spark, sf))
    return ac.branch_nodes(fx.user_positions(spark, sf), pairs).groupBy("user_id").agg(
        F.count("*").alias("n_nodes"), F.min("oui_id").alias("first_node"))


@register("branch_conflicts", sql("user_positions closure", """
WITH w AS (SELECT c_custkey user_id, CASE WHEN c_custkey % 3 = 0 THEN 'r' || (c_custkey % 5) ELSE 'n' || (c_custkey % 25) END oui_id FROM customer),
r AS (SELECT user_id, oui_id, oui_id h FROM w UNION ALL SELECT user_id, oui_id, ancestor_id FROM w JOIN closure USING (oui_id)
  UNION ALL SELECT user_id, w.oui_id, c.oui_id FROM w JOIN closure c ON c.ancestor_id = w.oui_id)
SELECT r.user_id, r.oui_id, min(h) held_oui_id FROM r JOIN user_positions p ON p.user_id = r.user_id AND p.oui_id = h GROUP BY ALL"""))
def branch_conflicts(spark, sf):
    wanted = table(spark, sf, "customer").selectExpr(
        "c_custkey user_id", "CASE WHEN c_custkey % 3 = 0 THEN concat('r', c_custkey % 5) ELSE concat('n', c_custkey % 25) END oui_id")
    return ac.branch_conflicts(wanted, fx.user_positions(spark, sf), ac.closure(fx.node_parents(spark, sf)))


@register("assignment_validity", sql("user_positions positions nodes", """
WITH h AS (SELECT user_id, oui_id, CASE WHEN user_id % 8 = 0 THEN '1-' || clearance ELSE position_id END position_id FROM user_positions)
SELECT user_id, h.oui_id, h.position_id FROM h JOIN nodes n USING (oui_id) JOIN positions p USING (position_id) WHERE n.ou_id <> p.ou_id"""))
def assignment_validity(spark, sf):
    held = fx.user_positions(spark, sf).selectExpr(
        "user_id", "oui_id", "CASE WHEN user_id % 8 = 0 THEN concat('1-', clearance) ELSE position_id END position_id")
    return ac.invalid_assignments(held, fx.positions(spark, sf), fx.nodes(spark, sf)).select("user_id", "oui_id", "position_id")


@register("user_profiles", sql("users user_positions nodes org_types positions", """
SELECT u.user_id, u.status, greatest(1, coalesce(max(p.clearance), 1)) max_clearance, coalesce(bool_or(t.ou_id IS NOT NULL AND t.parent_ou_id IS NULL), false) is_corp_member,
  coalesce(string_agg(p.oui_id || ':' || n.oui_name || ':' || t.ou_name || ':' || p.clearance, '|' ORDER BY p.oui_id), '') places
FROM users u LEFT JOIN user_positions p USING (user_id) LEFT JOIN nodes n USING (oui_id) LEFT JOIN org_types t USING (ou_id) GROUP BY u.user_id, u.status"""))
def user_profiles(spark, sf):
    held, nodes, types = fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf)
    named = held.join(nodes, "oui_id").join(types, "ou_id").groupBy("user_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "oui_id", "oui_name", "ou_name", "clearance"))), "|").alias("places"))
    users = fx.users(spark, sf)
    return users.join(ac.profiles(held, nodes, types, users), "user_id").join(named, "user_id", "left").select(
        "user_id", "status", "max_clearance", "is_corp_member", F.coalesce("places", F.lit("")).alias("places"))


@register("corp_members", sql("user_positions nodes org_types", """
SELECT DISTINCT user_id FROM user_positions JOIN nodes USING (oui_id) JOIN org_types USING (ou_id) WHERE parent_ou_id IS NULL"""))
def corp_members(spark, sf):
    return ac.corp_members(fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf))


@register("documents_of_nodes", sql("doc_nodes docs", "SELECT oui_id, count(DISTINCT doc_id) n_documents, max(sensitivity) max_level FROM doc_nodes JOIN docs USING (doc_id) GROUP BY 1"))
def documents_of_nodes(spark, sf):
    return fx.document_nodes(spark, sf).join(fx.documents(spark, sf), "doc_id").groupBy("oui_id").agg(
        F.count_distinct("doc_id").alias("n_documents"), F.max("sensitivity").alias("max_level"))


@register("parent_changes", sql("node_parents", """
WITH a AS (SELECT oui_id, CASE WHEN oui_id LIKE 'n1%' THEN 'r0' ELSE parent_oui_id END parent_oui_id FROM node_parents)
SELECT *, 'removed' change FROM (SELECT * FROM node_parents EXCEPT ALL SELECT * FROM a)
UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM node_parents)"""))
def parent_changes(spark, sf):
    before = fx.node_parents(spark, sf)
    after = before.selectExpr("oui_id", "CASE WHEN oui_id LIKE 'n1%' THEN 'r0' ELSE parent_oui_id END parent_oui_id")
    return ac.changed_parents(before, after)


@register("document_tuples", sql("tuples", "SELECT doc_id, subject, relation, required_clearance::INT required_clearance FROM tuples"))
def document_tuples(spark, sf):
    edges = fx.node_parents(spark, sf)
    return all_tuples(spark, sf, ac.closure(edges), fx.nodes(spark, sf))


@register("viewable_documents", sql("viewable users", """
SELECT user_id, count(*) n_view, count_if(can_edit) n_edit, sum(doc_id)::BIGINT id_sum FROM viewable GROUP BY 1"""))
def viewable_documents(spark, sf):
    held, nodes, pairs, profile = access_inputs(spark, sf)
    return ac.view_summary(fx.users(spark, sf), fx.documents(spark, sf), all_tuples(spark, sf, pairs, nodes), held, pairs, profile)


CTE["asked"] = ([], "SELECT DISTINCT user_id, event_id % (SELECT count(*) FROM documents) doc_id FROM events")


def asked(spark, sf):
    return fx.access_requests(spark, sf).select("user_id", "doc_id").distinct()


@register("view_edit_flags", sql("asked viewable", """SELECT a.user_id, a.doc_id, v.doc_id IS NOT NULL can_view, coalesce(can_edit, false) can_edit
FROM asked a LEFT JOIN viewable v ON v.user_id = a.user_id AND v.doc_id = a.doc_id"""))
def view_edit_flags(spark, sf):
    held, nodes, pairs, profile = access_inputs(spark, sf)
    return ac.access_of_pairs(asked(spark, sf), fx.documents(spark, sf), fx.document_nodes(spark, sf), nodes,
                              fx.node_parents(spark, sf), pairs, held, profile)


@register("viewable_or_owned", sql("docs users viewable", """
SELECT user_id, count(*) n_documents FROM (SELECT user_id, doc_id FROM viewable UNION
  SELECT owner_user_id, doc_id FROM docs JOIN users ON user_id = owner_user_id) GROUP BY 1"""))
def viewable_or_owned(spark, sf):
    held, nodes, pairs, profile = access_inputs(spark, sf)
    return ac.view_summary(
        fx.users(spark, sf), fx.documents(spark, sf), all_tuples(spark, sf, pairs, nodes), held, pairs, profile,
    ).select("user_id", F.col("n_view").alias("n_documents"))


@register("tuple_resync", sql("tuples docs", """
WITH o AS (SELECT doc_id, subject, relation, CASE WHEN relation = 'owner' THEN 0 ELSE 2 END req FROM tuples WHERE doc_id % 3 <> 0),
t AS (SELECT doc_id FROM docs WHERE status = 'approved'),
n AS (SELECT doc_id, subject, relation, required_clearance req FROM tuples)
SELECT change, count(*) n, sum(doc_id)::BIGINT id_sum FROM (
  SELECT doc_id, 'delete' change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) WHERE doc_id IN (SELECT doc_id FROM t)
  UNION ALL SELECT doc_id, 'write' FROM (SELECT * FROM n EXCEPT SELECT * FROM o) WHERE doc_id IN (SELECT doc_id FROM t)) GROUP BY 1"""))
def tuple_resync(spark, sf):
    """Stored tuples are stale or missing for some documents; approved ones are refreshed."""
    pairs = ac.closure(fx.node_parents(spark, sf))
    current = all_tuples(spark, sf, pairs, fx.nodes(spark, sf))
    stored = current.where("doc_id % 3 <> 0").withColumn(
        "required_clearance", F.when(F.col("relation") == "owner", 0).otherwise(2))
    changes = ac.tuple_changes(stored, current, fx.documents(spark, sf).where("status = 'approved'"))
    return changes.groupBy("change").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@register("active_grants", sql("grants", "SELECT user_id, doc_id FROM grants"))
def active_grants(spark, sf):
    return ac.active_grants(fx.access_requests(spark, sf), now())


@register("expired_grants", sql("requests", f"""SELECT request_id, 'revoked' status FROM requests WHERE status = 'approved' AND expires_at <= {NOW_TS}"""))
def expired_grants(spark, sf):
    return ac.settle_expiry(fx.access_requests(spark, sf), now()).where("status = 'revoked'").select("request_id", "status")


CTE["chunk_levels"] = (["chunk_index"], "SELECT document_id doc_id, greatest(1, max(chunk_sensitivity)) max_sensitivity FROM chunk_index GROUP BY 1")
CTE["latest"] = (["requests"], "SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY user_id, doc_id ORDER BY created_at DESC, request_id DESC) = 1")


def chunk_levels(spark, sf):
    return ac.max_chunk_sensitivity(chunk_index(spark, sf).withColumnRenamed("document_id", "doc_id"))


@register("max_chunk_sensitivity", sql("chunk_levels", "SELECT doc_id, max_sensitivity FROM chunk_levels"))
def max_chunk_sensitivity(spark, sf):
    return chunk_levels(spark, sf)


@register("latest_requests", sql("latest", "SELECT user_id, doc_id, request_id, status FROM latest"))
def latest_requests(spark, sf):
    return ac.latest_requests(fx.access_requests(spark, sf)).select("user_id", "doc_id", "request_id", "status")


@register("request_status_map", sql("requests", "SELECT user_id, doc_id, arg_max(status, (created_at, request_id)) status FROM requests GROUP BY ALL"))
def request_status_map(spark, sf):
    return fx.access_requests(spark, sf).groupBy("user_id", "doc_id").agg(
        F.max_by("status", F.struct("created_at", "request_id")).alias("status"))


@register("access_status", sql("asked profiles chunk_levels latest", """
SELECT a.user_id, a.doc_id, coalesce(max_sensitivity, 1) > coalesce(max_clearance, 1) has_restricted_chunks, status access_request_status,
  coalesce(strftime(CASE WHEN status = 'approved' THEN expires_at END, '%Y-%m-%d %H:%M:%S'), 'none') approved_until
FROM asked a LEFT JOIN profiles p ON p.user_id = a.user_id LEFT JOIN chunk_levels c ON c.doc_id = a.doc_id LEFT JOIN latest l ON l.user_id = a.user_id AND l.doc_id = a.doc_id"""))
def access_status(spark, sf):
    profile = ac.profiles(fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf))
    out = ac.access_status(asked(spark, sf), profile, chunk_levels(spark, sf), fx.access_requests(spark, sf))
    return out.withColumn("approved_until", F.coalesce(F.date_format("approved_until", "yyyy-MM-dd HH:mm:ss"), F.lit("none")))


@register("file_gate", sql("asked profiles chunk_levels grants", """
SELECT a.user_id, a.doc_id, coalesce(is_corp_member, false) OR coalesce(max_sensitivity, 1) <= coalesce(max_clearance, 1) OR g.doc_id IS NOT NULL file_open
FROM asked a LEFT JOIN profiles p ON p.user_id = a.user_id LEFT JOIN chunk_levels c ON c.doc_id = a.doc_id LEFT JOIN grants g ON g.user_id = a.user_id AND g.doc_id = a.doc_id"""))
def file_gate(spark, sf):
    profile = ac.profiles(fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf))
    grants = ac.active_grants(fx.access_requests(spark, sf), now())
    return ac.file_gate(asked(spark, sf), profile, chunk_levels(spark, sf), grants)


CTE["eff"] = (["asked", "user_positions", "doc_nodes", "closure"], """
SELECT user_id, doc_id, coalesce(min(CASE WHEN at_ = node THEN clearance END), min(CASE WHEN up THEN clearance END), max(CASE WHEN down THEN clearance END),
   max(CASE WHEN node IS NULL THEN clearance END), 1) effective_clearance
FROM (SELECT a.user_id, a.doc_id, p.oui_id at_, clearance, d.oui_id node,
   EXISTS (SELECT 1 FROM closure c WHERE c.oui_id = p.oui_id AND c.ancestor_id = d.oui_id) up,
   EXISTS (SELECT 1 FROM closure c WHERE c.oui_id = d.oui_id AND c.ancestor_id = p.oui_id) down
  FROM asked a JOIN user_positions p ON p.user_id = a.user_id LEFT JOIN doc_nodes d ON d.doc_id = a.doc_id) GROUP BY user_id, doc_id""")


@register("effective_clearance", sql("eff", "SELECT user_id, doc_id, effective_clearance FROM eff"))
def effective_clearance(spark, sf):
    return ac.effective_clearance(asked(spark, sf), fx.user_positions(spark, sf), fx.document_nodes(spark, sf),
                                  ac.closure(fx.node_parents(spark, sf)))


@register("upload_permission", sql("user_positions closure profiles", """
WITH w AS (SELECT c_custkey user_id, 'n' || (c_custkey * 7 % 25) oui_id FROM customer)
SELECT w.user_id, w.oui_id, coalesce(is_corp_member, false) OR EXISTS (SELECT 1 FROM user_positions p WHERE p.user_id = w.user_id AND
   (p.oui_id = w.oui_id OR p.oui_id IN (SELECT ancestor_id FROM closure c WHERE c.oui_id = w.oui_id))) allowed FROM w LEFT JOIN profiles USING (user_id)"""))
def upload_permission(spark, sf):
    wanted = table(spark, sf, "customer").selectExpr("c_custkey user_id", "concat('n', c_custkey * 7 % 25) oui_id")
    held = fx.user_positions(spark, sf)
    corp = ac.corp_members(held, fx.nodes(spark, sf), fx.org_types(spark, sf))
    return ac.upload_allowed(wanted, held, corp, ac.closure(fx.node_parents(spark, sf)))


@register("request_workflow", """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_id % 7 doc_id, (['request', 'approve', 'reject', 'revoke'])[event_id * 3 % 4 + 1] kind, ts,
   CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 1 HOUR * (event_id % 11 * 40 - 40) END ends,
   row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY ts, event_id) i FROM events),
s AS (SELECT user_id, doc_id, 0::BIGINT i, 'none' st, 0::BIGINT event_id, '' kind, '' before_, NULL::TIMESTAMP ts, NULL::TIMESTAMP ends FROM (SELECT DISTINCT user_id, doc_id FROM e)
  UNION ALL SELECT user_id, doc_id, i, CASE WHEN kind = 'request' AND now <> 'pending' THEN 'pending' WHEN kind = 'approve' AND now = 'pending' THEN 'approved'
     WHEN kind = 'reject' AND now = 'pending' THEN 'rejected' WHEN kind = 'revoke' AND now = 'approved' THEN 'revoked' ELSE now END, event_id, kind, now, ts,
     CASE WHEN kind = 'approve' AND now = 'pending' THEN new_end WHEN now = 'approved' THEN ends END
  FROM (SELECT e.user_id, e.doc_id, e.i, e.event_id, e.kind, e.ts, e.ends new_end, s.ends,
     CASE WHEN s.st = 'approved' AND s.ends <= e.ts THEN 'revoked' ELSE s.st END now
   FROM s JOIN e ON e.user_id = s.user_id AND e.doc_id = s.doc_id AND e.i = s.i + 1)),
done AS (SELECT * FROM s WHERE i > 0)
SELECT user_id, doc_id, event_id, kind, before_ state_before, before_ <> st AS valid, st state_after FROM done
UNION ALL SELECT user_id, doc_id, event_id, 'expire', 'approved', true, 'revoked' FROM done a WHERE kind = 'approve' AND before_ = 'pending' AND ends IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM done b WHERE b.user_id = a.user_id AND b.doc_id = a.doc_id AND b.i > a.i AND b.before_ <> b.st AND b.ts < a.ends)""")
def request_workflow(spark, sf):
    """Requests, decisions and revocations, with approvals that run out, some of them before they are given."""
    events = table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "event_id % 7 doc_id", "ts created_at",
        "element_at(array('request', 'approve', 'reject', 'revoke'), cast(event_id * 3 % 4 as int) + 1) kind",
        "CASE WHEN event_id % 3 > 0 THEN ts + make_dt_interval(0, cast(event_id % 11 * 40 - 40 as int)) END expires_at")
    return ac.apply_request_events(events)


@register("review_transitions", sql("docs profiles", """
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 150 ELSE doc_id % 50 * 2 END user_id, (['submit', 'approve', 'reject'])[doc_id // 4 % 3 + 1] AS act FROM documents),
j AS (SELECT a.doc_id, a.user_id, act, status, a.user_id = owner_user_id own, coalesce(is_corp_member, false) top FROM a JOIN docs USING (doc_id) LEFT JOIN profiles p ON p.user_id = a.user_id)
SELECT doc_id, user_id, act AS action, status, CASE WHEN act = 'submit' AND own AND status = 'uploaded' THEN CASE WHEN top THEN 'approved' ELSE 'review' END
   WHEN act = 'approve' AND top AND status IN ('review', 'uploaded') THEN 'approved' WHEN act = 'reject' AND top AND status IN ('review', 'uploaded') THEN 'draft' ELSE status END next_status,
  CASE WHEN act = 'submit' AND own AND status = 'uploaded' AND top THEN 'queued' WHEN act = 'approve' AND top AND status IN ('review', 'uploaded') THEN 'queued'
   WHEN act = 'reject' AND top AND status IN ('review', 'uploaded') THEN 'cancelled' ELSE 'none' END job_effect,
  CASE WHEN act = 'submit' AND NOT own THEN 'owner_required' WHEN act <> 'submit' AND NOT top THEN 'corp_required'
   WHEN (act = 'submit' AND status = 'uploaded') OR (act <> 'submit' AND status IN ('review', 'uploaded')) THEN 'ok' ELSE 'wrong_status' END reason FROM j"""))
def review_transitions(spark, sf):
    actions = table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN doc_id % 150 ELSE doc_id % 50 * 2 END user_id",
        "element_at(array('submit', 'approve', 'reject'), cast(doc_id div 4 % 3 as int) + 1) action")
    corp = ac.corp_members(fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf))
    return ac.review_decisions(actions, fx.documents(spark, sf), corp)


@register("role_decisions", sql("users docs", """
WITH r AS (SELECT d.doc_id, u.role, u.department own, CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 4 = 1 THEN u.department ELSE 'OTHER' END dep,
  u.user_id = d.owner_user_id is_owner, d.doc_id % 5 <> 0 can_edit, CASE WHEN d.doc_id % 6 = 0 THEN 'archived' ELSE d.status END st,
  (['public', 'internal', 'confidential', 'restricted', 'top_secret', ''])[d.doc_id % 6 + 1] cl, (['public', 'internal', 'confidential', 'restricted', 'top_secret'])[d.doc_id // 6 % 5 + 1] lv
  FROM docs d JOIN users u ON u.user_id = d.doc_id % 149),
k AS (SELECT *, coalesce(list_position(['public', 'internal', 'confidential', 'restricted', 'top_secret'], CASE WHEN cl = '' THEN 'internal' ELSE cl END), 0) ck,
  list_position(['public', 'internal', 'confidential', 'restricted', 'top_secret'], lv) lk FROM r)
SELECT doc_id, CASE WHEN role IN ('director', 'admin_auditor') THEN 'ok' WHEN dep IS NULL THEN CASE WHEN role = 'department_manager' THEN 'ok' ELSE 'only_managers_can_create_company_doc' END
   WHEN own = dep THEN 'ok' ELSE 'department_scope_denied' END create_reason,
  CASE WHEN is_owner THEN 'ok' WHEN NOT can_edit THEN 'fga_denied' WHEN st = 'archived' AND role <> 'admin_auditor' THEN 'archived_denied' WHEN ck < lk THEN 'clearance_denied'
   WHEN role IN ('department_manager', 'director', 'admin_auditor') THEN 'ok' ELSE 'role_denied' END update_reason FROM k"""))
def role_decisions(spark, sf):
    rows = fx.documents(spark, sf).withColumn("user_id", F.col("doc_id") % 149).join(
        fx.users(spark, sf).select("user_id", "role", "department"), "user_id")
    rows = rows.selectExpr(
        "*", "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN department ELSE 'OTHER' END dep",
        "CASE WHEN doc_id % 6 = 0 THEN 'archived' ELSE status END st",
        "element_at(array('public', 'internal', 'confidential', 'restricted', 'top_secret', ''), cast(doc_id % 6 as int) + 1) cl",
        "element_at(array('public', 'internal', 'confidential', 'restricted', 'top_secret'), cast(doc_id div 6 % 5 as int) + 1) lv")
    return rows.select(
        "doc_id", ac.create_decision(F.col("role"), F.col("department"), F.col("dep")).alias("create_reason"),
        ac.update_decision(F.col("user_id") == F.col("owner_user_id"), F.col("doc_id") % 5 != 0, F.col("st"),
                           F.col("role"), F.col("cl"), F.col("lv")).alias("update_reason"))


@register("job_visibility", sql("jobs profiles users", """
SELECT v.user_id, count(*) n_jobs, sum(job_id)::BIGINT id_sum FROM (SELECT DISTINCT user_id FROM events) v LEFT JOIN profiles p USING (user_id) LEFT JOIN users u USING (user_id)
JOIN jobs j ON j.created_by = v.user_id OR is_corp_member OR u.role IN ('director', 'admin_auditor') GROUP BY 1"""))
def job_visibility(spark, sf):
    viewers = table(spark, sf, "events").select("user_id").distinct()
    corp = ac.corp_members(fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf))
    return ac.job_summary(fx.jobs(spark, sf), viewers, corp, fx.users(spark, sf))


@register("request_listing", sql("requests docs users", """SELECT request_id, title, user_name requester, r.status FROM requests r LEFT JOIN docs d USING (doc_id) LEFT JOIN users u USING (user_id)"""))
def request_listing(spark, sf):
    return (fx.access_requests(spark, sf)
            .join(fx.documents(spark, sf).select("doc_id", "title"), "doc_id", "left")
            .join(fx.users(spark, sf).selectExpr("user_id", "user_name requester"), "user_id", "left")
            .select("request_id", "title", "requester", "status"))
