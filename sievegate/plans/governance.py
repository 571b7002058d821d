"""Detection and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import text as tx
from sievegate.operators import access as ac
from sievegate.operators import detection as dt
from sievegate.operators import policy as po
from sievegate.operators.common import unnest
from sievegate.plans import fixtures as fx
from sievegate.plans.fixtures import CTE, quote, sql
from sievegate.plans.registry import register
from sievegate.session import shared_dir
from sievegate.sources.tables import rows_table, table, text_table

BLANKS = "' ' || chr(9) || chr(10) || chr(13)"

# ---- personal data in SQL ---------------------------------------------------------


def _sql_spans() -> str:
    parts = []
    for i, (kind, pattern, score) in enumerate(fixed.PII_PATTERNS):
        parts.append(f"""SELECT doc_id, {i} pno, '{kind}' kind, {score}::DOUBLE score, ms[k] m,
          (list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT s
          FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) k FROM (SELECT doc_id,
             regexp_extract_all(text, {quote(pattern)}, 0, 'i') ms, regexp_split_to_array(text, {quote(pattern)}, 'i') ps FROM annotated))""")
    return "\n UNION ALL ".join(parts)


CTE["pii_all"] = (["annotated"], _sql_spans())
CTE["pii"] = (["pii_all"], """SELECT *, s + length(m) e, row_number() OVER (PARTITION BY doc_id ORDER BY s, length(m) DESC, pno) i
   FROM (SELECT * FROM pii_all QUALIFY row_number() OVER (PARTITION BY doc_id, s, length(m) ORDER BY pno) = 1)""")


def _sql_redact(source: str, name: str) -> None:
    CTE[name + "_steps"] = ([source, "annotated"], f"""SELECT doc_id, 0::BIGINT i, 0::BIGINT until, '' acc FROM annotated
      UNION ALL SELECT r.doc_id, p.i, CASE WHEN p.s >= until THEN p.e ELSE until END,
        CASE WHEN p.s >= until THEN acc || text[until + 1 : p.s] || '[' || p.kind || ']' ELSE acc END
      FROM {name}_steps r JOIN {source} p ON p.doc_id = r.doc_id AND p.i = r.i + 1 JOIN annotated a ON a.doc_id = r.doc_id""")
    CTE[name] = ([name + "_steps"], f"""SELECT r.doc_id, acc || text[until + 1 :] AS text, r.i > 0 redacted FROM
      (SELECT * FROM {name}_steps QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) r JOIN annotated a ON a.doc_id = r.doc_id""")


_sql_redact("pii", "redacted")
CTE["pii_named"] = (["pii"], """SELECT * REPLACE (kind || '-' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first_i) AS kind)
   FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, m) first_i FROM pii)""")
_sql_redact("pii_named", "anonymized")


@register("pii_spans", sql("pii", """SELECT doc_id, s::INT start_pos, e::INT end_pos, kind entity_type, m AS "value", score FROM pii"""))
def pii_spans(spark, sf):
    rows = fx.annotated(spark, sf).select("doc_id", dt.pii_spans(F.col("text")).alias("s"))
    return unnest(rows, ["doc_id"], "s", "e").select(
        "doc_id", F.col("e.start").alias("start_pos"), F.col("e.end").alias("end_pos"), "e.entity_type",
        F.col("e.text").alias("value"), "e.score")


@register("pii_type_counts", sql("pii", "SELECT kind entity_type, count(*) n_spans, count(DISTINCT doc_id) n_documents FROM pii GROUP BY 1"))
def pii_type_counts(spark, sf):
    rows = fx.annotated(spark, sf).select("doc_id", dt.pii_spans(F.col("text")).alias("s"))
    return unnest(rows, ["doc_id"], "s", "e").groupBy("e.entity_type").agg(
        F.count("*").alias("n_spans"), F.count_distinct("doc_id").alias("n_documents"))


@register("pii_redaction", sql("redacted", "SELECT doc_id, sha256(text) text_hash, redacted FROM redacted"))
def pii_redaction(spark, sf):
    rows = fx.annotated(spark, sf).withColumn("s", dt.pii_spans(F.col("text")))
    return rows.select("doc_id", F.sha2(dt.redact(F.col("text"), F.col("s")), 256).alias("text_hash"),
                       (F.size("s") > 0).alias("redacted"))


def _sql_director(t: str) -> str:
    for pattern, mark in fixed.DIRECTOR_REDACTIONS:
        t = f"regexp_replace({t}, {quote(pattern)}, {quote(mark)}, 'gi')"
    return t


@register("director_redaction", sql("annotated", f"SELECT doc_id, sha256({_sql_director('text')}) text_hash FROM annotated"))
def director_redaction(spark, sf):
    return fx.annotated(spark, sf).select("doc_id", F.sha2(dt.director_redaction(F.col("text")), 256).alias("text_hash"))


DIRECTOR_LIST = ", ".join(f"'{t}'" for t in fixed.DIRECTOR_MASK_TYPES)
CTE["readers"] = (["docs", "profiles"], """SELECT doc_id, is_corp_member, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE max_clearance END max_clearance
   FROM documents JOIN profiles ON user_id = doc_id % 4 * 50 % 150 + doc_id % 2""")
CTE["mask_spans"] = (["pii", "readers"], f"""SELECT p.* EXCLUDE (i), row_number() OVER (PARTITION BY p.doc_id ORDER BY s, length(m) DESC, pno) i
   FROM pii p JOIN readers r USING (doc_id) WHERE NOT (is_corp_member AND max_clearance >= 5) AND (NOT is_corp_member OR max_clearance < 4 OR kind IN ({DIRECTOR_LIST}))""")
_sql_redact("mask_spans", "masked")


def readers(spark, sf):
    profile = ac.profiles(fx.user_positions(spark, sf), fx.nodes(spark, sf), fx.org_types(spark, sf))
    docs = fx.annotated(spark, sf).withColumn("user_id", F.expr("doc_id % 4 * 50 % 150 + doc_id % 2"))
    held = ac.with_profiles(docs, profile.select("user_id", "is_corp_member", "max_clearance"), "doc_id")
    return held.withColumn(
        "max_clearance", F.when(F.col("doc_id") % 3 == 0, 4).otherwise(F.col("max_clearance")))


@register("masked_for_reader", sql("masked readers", """SELECT doc_id, sha256(text) text_hash, redacted pii_redacted FROM masked JOIN readers USING (doc_id)"""))
def masked_for_reader(spark, sf):
    return dt.mask_for_reader(readers(spark, sf)).select("doc_id", F.sha2("text", 256).alias("text_hash"), "pii_redacted")


def _sql_any(words: list[str]) -> str:
    import re

    return quote("|".join(re.sub(r"([.^$*+?()\[\]{}|\\&-])", r"\\\1", w) for w in words).replace("\\&", "&").replace("\\-", "-"))


CTE["secrets"] = (["annotated", "pii"], f"""SELECT a.doc_id, list_sort(list_distinct(regexp_extract_all(text, {_sql_any(fixed.HARD_SECRETS)}, 0, 'i'))) hard,
   list_sort(list_distinct(regexp_extract_all(text, {_sql_any(fixed.SOFT_SECRETS)}, 0, 'i'))) soft, p.doc_id IS NOT NULL has_pii
   FROM annotated a LEFT JOIN (SELECT DISTINCT doc_id FROM pii) p USING (doc_id)""")
TRIGGER = "CASE WHEN has_pii THEN 'pii' WHEN len(hard) > 0 THEN 'hard_secret' WHEN len(soft) > 0 THEN 'soft_secret' ELSE 'none' END"


@register("secret_keywords", sql("secrets", f"""SELECT doc_id, array_to_string(hard, '|') hard_secrets, array_to_string(soft, '|') soft_secrets, {TRIGGER} trigger_reason FROM secrets"""))
def secret_keywords(spark, sf):
    out = dt.scan_responses(fx.annotated(spark, sf))
    return out.select("doc_id", F.array_join(F.array_sort("hard_secrets"), "|").alias("hard_secrets"),
                      F.array_join(F.array_sort("soft_secrets"), "|").alias("soft_secrets"),
                      F.col("trigger").alias("trigger_reason"))


@register("response_decisions", sql("secrets readers", f"""
WITH t AS (SELECT doc_id, has_pii, {TRIGGER} tr, (['BLOCK', 'REDACT', 'ALLOW', NULL])[doc_id % 4 + 1] v FROM secrets)
SELECT doc_id, CASE WHEN is_corp_member AND max_clearance >= 5 THEN 'allow' WHEN tr <> 'none' AND v = 'BLOCK' THEN 'block'
  WHEN tr <> 'none' AND v = 'ALLOW' THEN 'allow' WHEN has_pii THEN 'redact' ELSE 'allow' END decision FROM t JOIN readers USING (doc_id)"""))
def response_decisions(spark, sf):
    rows = readers(spark, sf).withColumn("judge_action", F.expr(
        "element_at(array('block', 'REDACT', 'ALLOW', NULL), cast(doc_id % 4 as int) + 1)"))
    return dt.decide_responses(dt.scan_responses(rows)).select("doc_id", "decision")


INJ = "[" + ", ".join(f"regexp_matches(lower(text), {quote(p)}, 'i')" for p in fixed.INJECTION_PATTERNS) + "]"


@register("injection_check", sql("annotated", f"""SELECT doc_id, coalesce(list_position({INJ}, true), 0)::BIGINT pattern_no FROM annotated"""))
def injection_check(spark, sf):
    return fx.annotated(spark, sf).select("doc_id", dt.injection_pattern(F.col("text")).alias("pattern_no"))


@register("verdict_normalize", """SELECT doc_id, (['BLOCK', 'ALLOW', 'ALLOW', 'REWRITE', 'ALLOW'])[doc_id % 5 + 1] act, (['HIGH', 'LOW', 'LOW', 'MEDIUM', 'LOW'])[doc_id % 5 + 1] risk,
  (['JAILBREAK', 'SAFE', 'SAFE', 'AMBIGUOUS', 'SAFE'])[doc_id % 5 + 1] "class", CASE WHEN doc_id % 5 = 3 THEN 'new ' || doc_id ELSE '' END rewrite,
  CASE doc_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'LOW' END severity FROM documents""")
def verdict_normalize(spark, sf):
    raw = table(spark, sf, "documents").selectExpr("doc_id", """CASE cast(doc_id % 5 as int)
      WHEN 0 THEN '{"action": "block", "risk": "high", "class": "jailbreak"}' WHEN 1 THEN '{"action": "drop", "risk": "extreme"}'
      WHEN 2 THEN '{"action": "REWRITE", "rewrite": ""}' WHEN 3 THEN concat('{"action": "rewrite", "risk": "medium", "class": "ambiguous", "rewrite": "new ', doc_id, '"}')
      ELSE '{}' END v""", """CASE cast(doc_id % 3 as int) WHEN 0 THEN '{"severity": "huge", "action": "?"}' WHEN 1 THEN '{"leaked": true, "severity": "high", "action": "block"}' ELSE '{}' END j""")
    out = raw.select("doc_id", dt.normalize_verdict(F.col("v")).alias("v"), dt.normalize_judgement(F.col("j")).alias("j"))
    return out.select("doc_id", F.col("v.action").alias("act"), "v.risk", "v.class",
                      F.coalesce("v.rewrite", F.lit("")).alias("rewrite"), "j.severity")


@register("block_messages", """SELECT c AS "class", CASE c """ + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in fixed.BLOCK_MESSAGES.items())
          + f" ELSE {quote(fixed.BLOCK_MESSAGE_DEFAULT)} END message, n FROM (SELECT (['PROMPT_INJECTION', 'JAILBREAK', 'OFF_TOPIC', 'OTHER'])[event_id % 4 + 1] c, count(*) n FROM events GROUP BY 1)")
def block_messages(spark, sf):
    kinds = table(spark, sf, "events").selectExpr(
        "element_at(array('PROMPT_INJECTION', 'JAILBREAK', 'OFF_TOPIC', 'OTHER'), cast(event_id % 4 as int) + 1) class")
    return kinds.groupBy("class").agg(F.count("*").alias("n")).withColumn("message", dt.block_message(F.col("class")))


# ---- entities and flags ------------------------------------------------------------------

def _sql_entities() -> str:
    parts = []
    for label, pattern, blind, group in fixed.ENTITY_PATTERNS:
        flag = "'i'" if blind else "''"
        value = f"regexp_extract(ms[k], {quote(pattern)}, 1, {flag})" if group else "ms[k]"
        parts.append(f"""SELECT doc_id, '{label}' label, {value} v,
          (list_sum(list_transform(ps[1:k], lambda x: length(x))) + list_sum(list_transform(ms[1:k], lambda x: length(x))))::INT e
          FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) k FROM (SELECT doc_id,
             regexp_extract_all(text, {quote(pattern)}, 0, {flag}) ms, regexp_split_to_array(text, {quote(pattern)}, {flag}) ps FROM annotated))""")
    return "\n UNION ALL ".join(parts)


CTE["ents"] = (["annotated"], _sql_entities())


@register("structured_entities", sql("ents", 'SELECT doc_id, label, v AS "value", (e - length(v))::INT start_pos, e end_pos FROM ents'))
def structured_entities(spark, sf):
    return dt.entities(fx.annotated(spark, sf)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


BUILTIN = [(k, v) for k, v in fixed.ENTITY_FLAGS.items()]
CTE["builtin_flags"] = ([], fx.values("entity_type, flags", BUILTIN))
CTE["flag_map"] = (["builtin_flags", "domain_types", "domains"], """SELECT coalesce(b.entity_type, d.entity_type) entity_type, coalesce(d.flags, b.flags) flags
   FROM builtin_flags b FULL JOIN (SELECT t.* FROM domain_types t JOIN domains USING (domain_code) WHERE is_active) d ON d.entity_type = b.entity_type""")


def flag_table(spark, sf):
    builtin = rows_table(spark, "entity_type string, flags array<string>", BUILTIN)
    return dt.flag_map(builtin, po.active_entity_types(fx.domain_types(spark, sf), fx.domains(spark, sf)))


@register("flags_in_use", sql("flag_map ents", """SELECT entity_type, array_to_string(any_value(flags), ',') flags, count(DISTINCT doc_id) n_documents
   FROM flag_map LEFT JOIN ents ON label = entity_type GROUP BY 1"""))
def flags_in_use(spark, sf):
    """Flags per entity type, configured over built-in, with the documents they touch."""
    found = dt.label_rows(fx.annotated(spark, sf)).groupBy(F.col("label").alias("entity_type")).agg(
        F.count("*").alias("n"))
    return flag_table(spark, sf).join(found, "entity_type", "left").select(
        "entity_type", F.array_join("flags", ",").alias("flags"), F.coalesce("n", F.lit(0)).alias("n_documents"))


_KEY = ", ".join(f"regexp_matches(text, {quote(p)}, 'i') k_{f}" for f, p in fixed.KEYWORD_FLAGS)
_FLAGS = ", ".join(
    f"coalesce(list_contains(fs, '{f}'), false)" + (f" OR k_{f}" if f in dict(fixed.KEYWORD_FLAGS) else "") + f" {f}" for f in fixed.FLAGS)
CTE["flagged"] = (["ents", "flag_map", "annotated"], f"""SELECT a.doc_id, coalesce(labels, '') entity_types, {_FLAGS} FROM (SELECT doc_id, {_KEY} FROM annotated) a
   LEFT JOIN (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) labels, list_distinct(flatten(list(coalesce(flags, [])))) fs
     FROM (SELECT DISTINCT doc_id, label FROM ents) LEFT JOIN flag_map ON entity_type = label GROUP BY 1) e USING (doc_id)""")


def flagged(spark, sf):
    return dt.boolean_labels(fx.annotated(spark, sf), flag_table(spark, sf))


@register("boolean_labels", sql("flagged", "SELECT doc_id, entity_types, " + ", ".join(fixed.FLAGS) + " FROM flagged"))
def boolean_labels(spark, sf):
    return flagged(spark, sf).withColumn("entity_types", F.array_join("entity_types", ","))


@register("chunk_sensitivity", sql("flagged docs", """SELECT doc_id, greatest(1, least(5, sensitivity + CASE WHEN has_pii OR has_financial OR has_credential OR has_legal OR has_strategic OR has_hr
   THEN least(2 * has_credential::INT + has_pii::INT + has_hr::INT + has_strategic::INT + has_financial::INT, 2) ELSE -1 END))::INT chunk_sensitivity FROM flagged JOIN docs USING (doc_id)"""))
def chunk_sensitivity(spark, sf):
    rows = flagged(spark, sf).join(fx.documents(spark, sf).select("doc_id", "sensitivity"), "doc_id")
    return rows.select("doc_id", dt.chunk_sensitivity(F.col("sensitivity")).alias("chunk_sensitivity"))


LEVELS_SQL = " ".join(
    f"WHEN regexp_matches(text, {quote('|'.join(f'(?:{p})' for p in fixed.LEVEL_PATTERNS[lv]))}, 'i') THEN {lv}" for lv in (4, 3, 2))


@register("sensitivity_classes", sql("annotated", f"""SELECT doc_id, CASE WHEN doc_id % 7 BETWEEN 1 AND 5 AND doc_id % 2 = 0 THEN doc_id % 7 ELSE CASE {LEVELS_SQL} ELSE 1 END END::INT "level" FROM annotated"""))
def sensitivity_classes(spark, sf):
    stored = F.expr("CASE WHEN doc_id % 2 = 0 THEN cast(doc_id % 7 as string) WHEN doc_id % 3 = 0 THEN 'x' END")
    return fx.annotated(spark, sf).select("doc_id", dt.classify_sensitivity(stored, F.col("text")).alias("level"))


@register("level_resync", """WITH c AS (SELECT doc_id, k, CASE WHEN (doc_id + k) % 3 = 0 THEN NULL ELSE (1 + (doc_id + k) % 5)::INT END llm, (1 + doc_id % 5)::INT o, (1 + doc_id % 4)::INT n
   FROM documents, (SELECT unnest(range(3)) k) WHERE doc_id % 2 = 0)
SELECT n AS new_sensitivity, CASE WHEN llm IS NULL THEN n ELSE greatest(1, least(5, n + llm - o)) END::INT chunk_sensitivity, count(*) n_chunks, min(doc_id || '-' || k) first_chunk FROM c GROUP BY ALL""")
def level_resync(spark, sf):
    docs = table(spark, sf, "documents")
    chunks = docs.selectExpr("doc_id", "explode(sequence(0, 2)) k").selectExpr(
        "concat(doc_id, '-', k) chunk_id", "doc_id", "CASE WHEN (doc_id + k) % 3 = 0 THEN NULL ELSE cast(1 + (doc_id + k) % 5 as int) END llm_chunk_sensitivity")
    changes = docs.where("doc_id % 2 = 0").selectExpr(
        "doc_id", "cast(1 + doc_id % 5 as int) old_sensitivity", "cast(1 + doc_id % 4 as int) new_sensitivity")
    return dt.resync_levels(chunks, changes).groupBy("new_sensitivity", "chunk_sensitivity").agg(
        F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


# ---- intent, risk, domains ------------------------------------------------------------------

def _sql_intent(t: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({t}), {quote(w)})" for w in dict.fromkeys(ws)) + f" THEN '{n}'"
        for n, ws in fixed.INTENT_KEYWORDS)
    return f"CASE {cases} ELSE 'lookup' END"


@register("intent_classes", f"""SELECT conv_id, turn, {_sql_intent('text')} intent, {_sql_intent('text')} = 'lookup' AND regexp_matches(text, {quote(fixed.AMBIGUOUS_QUERY)}, 'i') ambiguous FROM
  (SELECT conv_id, turn, text || (['', ' xuất csv', ' so sánh', ' list all', ' ý chính', ' thống kê'])[turn % 6 + 1] AS text FROM conversations)""")
def intent_classes(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("text", F.expr(
        "concat(text, element_at(array('', ' xuất csv', ' so sánh', ' list all', ' ý chính', ' thống kê'), cast(turn % 6 as int) + 1))"))
    return rows.select("conv_id", "turn", po.intent_class(F.col("text")).alias("intent"), po.is_ambiguous(F.col("text")).alias("ambiguous"))


# One context per document: its owner asks with the document's planted line.
CTE["ctx"] = (["docs", "users", "profiles", "eff_owner"], f"""SELECT d.doc_id, u.user_id, u.role, u.department own_department,
    (['BUILDING', 'AUTOMOBILE', 'MACHINERY', ''])[d.doc_id % 4 + 1] item_department, p.max_clearance user_level, d.sensitivity declared_level,
    coalesce(e.effective_clearance, 1) effective_clearance, d.doc_id % 6 = 0 off_hours, pl.planted query, p.is_corp_member
  FROM docs d JOIN users u ON u.user_id = d.owner_user_id JOIN profiles p ON p.user_id = u.user_id
  JOIN (VALUES {", ".join(f"({i}, {quote(t)})" for i, t in enumerate(fx.PLANTED))}) pl(k, planted) ON k = d.doc_id // 3 % {len(fx.PLANTED)}
  LEFT JOIN eff_owner e ON e.doc_id = d.doc_id""")
CTE["eff_owner"] = (["docs", "user_positions", "doc_nodes", "closure"], """SELECT doc_id,
    coalesce(min(CASE WHEN at_ = node THEN clearance END), min(CASE WHEN up THEN clearance END), max(CASE WHEN down THEN clearance END),
      max(CASE WHEN node IS NULL THEN clearance END), 1) effective_clearance
  FROM (SELECT a.doc_id, p.oui_id at_, clearance, d.oui_id node,
     EXISTS (SELECT 1 FROM closure c WHERE c.oui_id = p.oui_id AND c.ancestor_id = d.oui_id) up,
     EXISTS (SELECT 1 FROM closure c WHERE c.oui_id = d.oui_id AND c.ancestor_id = p.oui_id) down
    FROM docs a JOIN user_positions p ON p.user_id = a.owner_user_id LEFT JOIN doc_nodes d ON d.doc_id = a.doc_id) GROUP BY doc_id""")


def contexts(spark, sf):
    docs, users = fx.documents(spark, sf), fx.users(spark, sf)
    held = fx.user_positions(spark, sf)
    profile = ac.profiles(held, fx.nodes(spark, sf), fx.org_types(spark, sf))
    asked = docs.selectExpr("doc_id", "owner_user_id user_id", "sensitivity declared_level")
    eff = ac.effective_clearance(asked, held, fx.document_nodes(spark, sf), ac.closure(fx.node_parents(spark, sf)))
    lines = rows_table(spark, "k bigint, query string", list(enumerate(fx.PLANTED)))
    return (
        asked.withColumn("k", F.expr(f"doc_id div 3 % {len(fx.PLANTED)}")).join(lines, "k")
        .join(users.selectExpr("user_id", "role", "department own_department"), "user_id")
        .join(profile.selectExpr("user_id", "max_clearance user_level", "is_corp_member"), "user_id")
        .join(eff, ["user_id", "doc_id"], "left")
        .selectExpr("doc_id", "user_id", "role", "own_department", "user_level", "declared_level", "query", "is_corp_member",
                    "coalesce(effective_clearance, 1) effective_clearance", "doc_id % 6 = 0 off_hours",
                    "element_at(array('BUILDING', 'AUTOMOBILE', 'MACHINERY', ''), cast(doc_id % 4 as int) + 1) item_department")
    )


_CROSS = "(own_department <> '' AND item_department <> '' AND lower(own_department) <> lower(item_department))"
CTE["risk"] = (["ctx"], f"""SELECT *, round(least(1.0::DOUBLE, CASE intent WHEN 'export' THEN 0.4 WHEN 'aggregate' THEN 0.2 WHEN 'compare' THEN 0.2 ELSE 0 END::DOUBLE
    + CASE WHEN {_CROSS} THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN gap > 0 THEN least(0.35, 0.15 * gap) ELSE 0 END::DOUBLE + CASE WHEN off_hours THEN 0.1 ELSE 0 END::DOUBLE
    + CASE WHEN {" OR ".join(f"contains(lower(query), {quote(w)})" for w in fixed.RISK_KEYWORDS)} THEN 0.15 ELSE 0 END::DOUBLE), 3) risk_score
  FROM (SELECT *, {_sql_intent('query')} intent, declared_level - user_level gap FROM ctx)""")


@register("intent_risk", sql("risk", f"""SELECT doc_id, intent, risk_score, CASE WHEN risk_score >= 0.7 THEN 'suspicious' WHEN intent = 'export' AND {_CROSS} THEN 'bulk_extraction'
  WHEN {_CROSS} THEN 'cross_dept' ELSE 'normal' END risk_signal FROM risk"""))
def intent_risk(spark, sf):
    rows = contexts(spark, sf).withColumn("intent", po.intent_class(F.col("query"))).withColumn("r", po.intent_risk(
        F.col("intent"), F.col("query"), F.col("own_department"), F.col("item_department"),
        F.col("user_level"), F.col("declared_level"), F.col("off_hours")))
    return rows.select("doc_id", "intent", F.col("r.score").alias("risk_score"), F.col("r.signal").alias("risk_signal"))


LEVELS = "['Public', 'Internal', 'Confidential', 'Restricted', 'TopSecret']"


@register("effective_levels", sql("docs flagged", f"""SELECT doc_id, ({LEVELS})[greatest(sensitivity, 1 + doc_id % 4, CASE WHEN has_pii THEN 3 ELSE 1 END)] level_name FROM docs JOIN flagged USING (doc_id)"""))
def effective_levels(spark, sf):
    rows = flagged(spark, sf).join(fx.documents(spark, sf), "doc_id")
    return rows.select("doc_id", po.effective_level(
        F.col("sensitivity"), (1 + F.col("doc_id") % 4).cast("int"), F.col("has_pii")).alias("level_name"))


CTE["outside"] = (["domain_scores"], "SELECT doc_id, domain_code, CASE WHEN doc_id % 5 = 0 THEN confidence / 10 ELSE confidence END confidence FROM domain_scores WHERE doc_id % 17 <> 0")
CTE["dscore"] = (["ents", "domain_types", "domains", "outside", "docs"], """SELECT doc_id, domain_code, conf, given FROM (
   SELECT d.doc_id, m.domain_code, o.confidence given, round(0.4 * coalesce(o.confidence, 0) + 0.6 * coalesce(n / size::DOUBLE, 0), 3) conf, o.confidence IS NULL AND n IS NULL untouched
   FROM docs d CROSS JOIN (SELECT domain_code FROM domains WHERE is_active) m LEFT JOIN outside o ON o.doc_id = d.doc_id AND o.domain_code = m.domain_code
   LEFT JOIN (SELECT doc_id, domain_code, count(*) n FROM (SELECT DISTINCT doc_id, label FROM ents) JOIN domain_types ON entity_type = label GROUP BY ALL) v ON v.doc_id = d.doc_id AND v.domain_code = m.domain_code
   LEFT JOIN (SELECT domain_code, count(*) size FROM domain_types GROUP BY 1) z ON z.domain_code = m.domain_code) WHERE NOT untouched""")
CTE["dpick"] = (["dscore"], """SELECT doc_id, domain_code, conf confidence FROM dscore WHERE conf >= 0.3
   UNION ALL SELECT doc_id, CASE WHEN given IS NULL THEN 'GEN-00' ELSE domain_code END, coalesce(round(given, 3), 1.0) FROM (
     SELECT *, max(conf) OVER (PARTITION BY doc_id) mx, row_number() OVER (PARTITION BY doc_id ORDER BY given DESC NULLS LAST, domain_code) r FROM dscore) WHERE mx < 0.3 AND r = 1""")


def domain_rows(spark, sf):
    labels = dt.label_rows(fx.annotated(spark, sf))
    outside = fx.domain_scores(spark, sf).where("doc_id % 17 <> 0").withColumn(
        "confidence", F.when(F.col("doc_id") % 5 == 0, F.col("confidence") / 10).otherwise(F.col("confidence")))
    return labels, fx.domain_types(spark, sf), outside, fx.domains(spark, sf)


@register("domain_scores", sql("dpick", "SELECT doc_id, domain_code, confidence FROM dpick"))
def domain_scores(spark, sf):
    labels, types, outside, domains = domain_rows(spark, sf)
    return po.domain_scores(labels, types, outside, domains)


# ---- rules and contracts ------------------------------------------------------------------------

CTE["main_domain"] = (["dpick"], "SELECT doc_id, domain_code primary_domain FROM dpick QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, domain_code) = 1")
CTE["full_ctx"] = (["ctx", "main_domain", "domains"], f"""SELECT c.*, coalesce(primary_domain, 'GEN-00') primary_domain, {_sql_intent('query')} intent,
    greatest(declared_level, coalesce(base_sensitivity, 2)) - 1 lv FROM ctx c LEFT JOIN main_domain USING (doc_id) LEFT JOIN domains ON domain_code = primary_domain""")
CTE["cand"] = (["full_ctx", "dpick", "rules"], f"""SELECT c.doc_id, r.*, CASE WHEN r.domain_code IS NULL THEN 'GLOBAL' ELSE primary_domain END dom,
    round(CASE WHEN list_contains(forced_roles, role) THEN CASE WHEN mandatory THEN 1.0 ELSE 0.95 END
      ELSE least(1.0, CASE WHEN len(forced_roles) = 0 AND len(exempt_roles) = 0 THEN 0.6 ELSE 0.8 END + CASE WHEN mandatory THEN 0.2 ELSE 0 END) END, 3)::DOUBLE score
  FROM full_ctx c JOIN rules r ON r.is_active AND (r.domain_code IS NULL OR EXISTS (SELECT 1 FROM dpick p WHERE p.doc_id = c.doc_id AND p.domain_code = r.domain_code))
  WHERE NOT list_contains(exempt_roles, role) AND (list_contains(forced_roles, role) OR (
    (min_sensitivity IS NULL OR lv >= list_position({LEVELS}, min_sensitivity) - 1) AND (min_clearance IS NULL OR effective_clearance < min_clearance)
    AND (len(intents) = 0 OR list_contains(intents, intent)) AND (NOT cross_dept_only OR NOT (own_department <> '' AND item_department <> '' AND lower(own_department) = lower(item_department)))))""")
CTE["sel"] = (["cand", "full_ctx"], """SELECT doc_id, rule_code, action, priority, mandatory, max_detail, numeric_granularity, dom, score FROM cand
  UNION ALL SELECT doc_id, 'FALLBACK', 'allow', 0, false, 'summarize', 'exact', 'GLOBAL', 1.0 FROM full_ctx WHERE doc_id NOT IN (SELECT doc_id FROM cand)""")
CTE["relevance"] = (["docs", "rules"], "SELECT doc_id, rule_code FROM docs, rules WHERE doc_id % 3 <> 0 AND (doc_id + length(rule_code)) % 4 <> 0")
CTE["rel"] = (["sel", "relevance"], """SELECT * EXCLUDE (judged, n, named, any_left) FROM (SELECT *, bool_or(named OR mandatory) OVER (PARTITION BY doc_id) any_left FROM (
    SELECT *, doc_id IN (SELECT doc_id FROM relevance) judged, count(*) OVER (PARTITION BY doc_id) n, (doc_id, rule_code) IN (SELECT (doc_id, rule_code) FROM relevance) named FROM sel))
  WHERE NOT judged OR n = 1 OR NOT any_left OR named OR mandatory""")
DET = "coalesce(list_position(['summarize', 'generalize', 'anonymize', 'redact'], max_detail), 0)"
NUM = "coalesce(list_position(['exact', 'range_only', 'aggregated', 'hidden'], numeric_granularity), 0)"


def _sql_resolve(source: str) -> str:
    return f"""SELECT doc_id, CASE WHEN b THEN 'block' WHEN c THEN 'conditional' WHEN w THEN 'watermark' WHEN a THEN 'allow' ELSE 'block' END decision,
    CASE WHEN b THEN 'block_overrides' WHEN c THEN 'conditional_merged' WHEN w THEN 'watermark_only' WHEN a THEN 'allow_only' ELSE 'fallback_deny' END decision_reason,
    CASE WHEN b THEN wb WHEN c THEN wc WHEN w THEN ww WHEN a THEN wa END winning_rule,
    CASE WHEN b THEN 'generalize' WHEN c THEN coalesce(det, 'generalize') ELSE 'generalize' END max_detail,
    CASE WHEN b THEN 'aggregated' WHEN c THEN coalesce(num, 'aggregated') ELSE 'aggregated' END numeric_granularity, n_rules
  FROM (SELECT doc_id, bool_or(action = 'block') b, bool_or(action = 'conditional') c, bool_or(action = 'watermark') w, bool_or(action = 'allow') a,
    arg_min(rule_code, (-priority, rule_code)) FILTER (action = 'block') wb, arg_min(rule_code, (-priority, rule_code)) FILTER (action = 'conditional') wc,
    arg_min(rule_code, (-priority, rule_code)) FILTER (action = 'watermark') ww, arg_min(rule_code, (-priority, rule_code)) FILTER (action = 'allow') wa,
    arg_min(max_detail, (-{DET}, rule_code)) FILTER (action = 'conditional') det, arg_min(numeric_granularity, (-{NUM}, rule_code)) FILTER (action = 'conditional') num,
    count(*) n_rules FROM {source} GROUP BY doc_id)"""


CTE["decided"] = (["sel"], _sql_resolve("sel"))
CTE["decided_rel"] = (["rel"], _sql_resolve("rel"))


def full_contexts(spark, sf):
    labels, types, outside, domains = domain_rows(spark, sf)
    shared_dir(spark)
    scores = po.domain_scores(labels, types, outside, domains).checkpoint()  # read several times below
    main = po.primary_domain(scores).select("doc_id", F.col("domain_code").alias("primary_domain"))
    base = domains.selectExpr("domain_code primary_domain", "base_sensitivity")
    rows = contexts(spark, sf).join(main, "doc_id", "left").join(base, "primary_domain", "left").withColumn(
        "primary_domain", F.coalesce("primary_domain", F.lit("GEN-00")))
    rows = rows.withColumn("intent", po.intent_class(F.col("query"))).withColumn("effective_level", po.effective_level(
        F.col("declared_level"), F.coalesce("base_sensitivity", F.lit(2)), F.lit(False)))
    return rows.withColumn("user_levels", F.array().cast("array<int>")).withColumn(
        "item_level", F.lit(None).cast("int")), scores


def selected_rules(spark, sf):
    ctx, scores = full_contexts(spark, sf)
    cand = po.rule_candidates(ctx, scores.select("doc_id", "domain_code"), fx.rules(spark, sf), "doc_id")
    return po.select_rules(ctx, cand, "doc_id")


@register("rule_candidates", sql("cand", "SELECT doc_id, rule_code, action, dom AS \"domain\", score, priority FROM cand"))
def rule_candidates(spark, sf):
    ctx, scores = full_contexts(spark, sf)
    return po.rule_candidates(ctx, scores.select("doc_id", "domain_code"), fx.rules(spark, sf), "doc_id").select(
        "doc_id", "rule_code", "action", "domain", "score", "priority")


@register("rule_selection", sql("sel", "SELECT doc_id, count(*) n_rules, string_agg(rule_code, ',' ORDER BY rule_code) rule_codes, count(*) > 8 needs_human_review FROM sel GROUP BY 1"))
def rule_selection(spark, sf):
    return selected_rules(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("n_rules"), F.array_join(F.array_sort(F.collect_list("rule_code")), ",").alias("rule_codes"),
        (F.count("*") > fixed.MAX_RULES_BEFORE_REVIEW).alias("needs_human_review"))


@register("conflict_resolution", sql("decided", "SELECT * FROM decided"))
def conflict_resolution(spark, sf):
    return po.resolve_conflicts(selected_rules(spark, sf), "doc_id").drop("needs_human_review", "applied_rules")


@register("rule_relevance", sql("decided_rel", "SELECT * FROM decided_rel"))
def rule_relevance(spark, sf):
    codes = "array(" + ", ".join(f"'{r[0]}'" for r in fx.RULES) + ")"
    relevant = table(spark, sf, "documents").where("doc_id % 3 <> 0").selectExpr(
        "doc_id", f"explode({codes}) rule_code").where("(doc_id + length(rule_code)) % 4 <> 0")
    kept = po.keep_relevant(selected_rules(spark, sf), relevant, "doc_id")
    return po.resolve_conflicts(kept, "doc_id").drop("needs_human_review", "applied_rules")


_RISK_PARTS = [
    ("intent = 'export'", "0.4", "export_intent(+0.4)"), ("intent IN ('aggregate', 'compare')", "0.2", "aggregate/compare_intent(+0.2)"),
    (_CROSS, "0.25", "cross_department(+0.25)"), ("off_hours", "0.1", "off_hours(+0.1)"),
    ("(" + " OR ".join(f"contains(lower(query), {quote(w)})" for w in fixed.RISK_KEYWORDS) + ")", "0.15", "sensitive_keyword(+0.15)")]
# A contract's item level is 1, which no user is below: the level gap has no part in its risk.
CTE["contract_risk"] = (["full_ctx"], f"""SELECT *, CASE WHEN risk_score >= 0.7 THEN 'suspicious' WHEN intent = 'export' AND {_CROSS} THEN 'bulk_extraction'
    WHEN {_CROSS} THEN 'cross_dept' ELSE 'normal' END risk_signal,
    coalesce(nullif(concat_ws('; ', {", ".join(f"CASE WHEN {t} THEN '{r}' END" for t, _, r in _RISK_PARTS)}), ''), 'no_risk_factors') risk_reasoning
  FROM (SELECT *, round(least(1.0::DOUBLE, {" + ".join(f"CASE WHEN {t} THEN {v} ELSE 0 END::DOUBLE" for t, v, _ in _RISK_PARTS)}), 3) risk_score FROM full_ctx)""")


@register("policy_contracts", sql("decided sel contract_risk dpick", f"""
SELECT 'PC-' || substr(sha256(f.doc_id || '|' || query || '|' || role), 1, 12) contract_id, f.doc_id, doms domains, primary_domain, ({LEVELS})[lv + 1] effective_level, intent,
  d.decision, d.decision_reason, d.max_detail, d.numeric_granularity, d.winning_rule, rs applied_rules, d.n_rules, d.n_rules > 8 needs_human_review,
  risk_score, risk_signal, risk_reasoning
FROM contract_risk f JOIN decided d USING (doc_id) JOIN (SELECT doc_id, string_agg(rule_code, ',' ORDER BY rule_code) rs FROM sel GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(domain_code, ',' ORDER BY domain_code) doms FROM dpick GROUP BY 1) USING (doc_id)"""))
def policy_contracts(spark, sf):
    labels, types, outside, domains = domain_rows(spark, sf)
    return po.contracts(contexts(spark, sf), labels, types, outside, domains, fx.rules(spark, sf))


NOTICE = "CASE max_detail " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in fixed.TRANSFORM_NOTICES.items()) + " END"
CTE["enforced"] = (["decided", "ctx", "annotated"], f"""SELECT doc_id, user_id, CASE WHEN is_corp_member THEN text WHEN decision = 'conditional' THEN {NOTICE}
    WHEN decision = 'watermark' THEN text || {" || ".join(["chr(10)", "chr(10)", quote(fixed.WATERMARK_SUFFIX.strip())])} ELSE text END AS text
  FROM annotated JOIN ctx USING (doc_id) JOIN decided USING (doc_id) WHERE is_corp_member OR decision <> 'block'""")


def enforced_rows(spark, sf):
    rows = fx.annotated(spark, sf).join(contexts(spark, sf).select("doc_id", "user_id", "is_corp_member"), "doc_id")
    return po.enforce(rows, po.resolve_conflicts(selected_rules(spark, sf), "doc_id"), "doc_id")


@register("enforced_texts", sql("enforced", "SELECT doc_id, sha256(text) text_hash FROM enforced"))
def enforced_texts(spark, sf):
    return enforced_rows(spark, sf).select("doc_id", F.sha2("text", 256).alias("text_hash"))


# Every digit behind a digit becomes 0.
_COARSE = """array_to_string(list_transform(range(1, length(r.text) + 1), lambda i: CASE WHEN i > 1 AND regexp_full_match(r.text[i], '[0-9]')
    AND regexp_full_match(r.text[i - 1], '[0-9]') THEN '0' ELSE r.text[i] END), '')"""
CTE["masked_texts"] = (["decided", "ctx", "annotated", "redacted", "anonymized"], f"""SELECT doc_id, CASE WHEN is_corp_member THEN a.text WHEN decision = 'conditional' THEN
      CASE max_detail WHEN 'redact' THEN CASE WHEN numeric_granularity = 'hidden' THEN regexp_replace(r.text, '[0-9]+(?:[.,][0-9]+)*', '[#]', 'g')
        WHEN numeric_granularity IN ('aggregated', 'range_only') THEN {_COARSE} ELSE r.text END
      WHEN 'anonymize' THEN n.text ELSE {NOTICE} END
    WHEN decision = 'watermark' THEN a.text || {" || ".join(["chr(10)", "chr(10)", quote(fixed.WATERMARK_SUFFIX.strip())])} ELSE a.text END AS text
  FROM annotated a JOIN ctx USING (doc_id) JOIN decided USING (doc_id) JOIN redacted r USING (doc_id) JOIN anonymized n USING (doc_id) WHERE is_corp_member OR decision <> 'block'""")


@register("masked_texts", sql("masked_texts", "SELECT doc_id, sha256(text) text_hash FROM masked_texts"))
def masked_texts(spark, sf):
    """Conditions that mask and alias what they can instead of putting a notice."""
    rows = fx.annotated(spark, sf).join(contexts(spark, sf).select("doc_id", "is_corp_member"), "doc_id")
    decided = po.resolve_conflicts(selected_rules(spark, sf), "doc_id")
    return po.enforce(rows, decided, "doc_id", masks=True).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@register("restricted_results", sql("enforced", f"SELECT user_id, bool_or(text = {quote(fixed.REDACT_NOTICE)}) has_restricted, bool_and(text = {quote(fixed.REDACT_NOTICE)}) all_restricted FROM enforced GROUP BY 1"))
def restricted_results(spark, sf):
    return po.restricted_results(enforced_rows(spark, sf), "user_id")


@register("applied_rules", sql("sel decided ctx", """SELECT DISTINCT user_id, s.rule_code, s.action FROM sel s JOIN decided d USING (doc_id) JOIN ctx c USING (doc_id) WHERE d.decision <> 'allow' AND s.action = d.decision"""))
def applied_rules(spark, sf):
    selected = selected_rules(spark, sf).checkpoint()
    decided = po.resolve_conflicts(selected, "doc_id")
    users = fx.documents(spark, sf).selectExpr("doc_id", "owner_user_id user_id")
    return po.applied_rules(selected.join(users, "doc_id"), decided, "doc_id", "user_id")


@register("masked_numbers", sql("redacted", r"""SELECT doc_id, sha256(regexp_replace(text, '\d+(?:[.,]\d+)*', '[#]', 'g')) text_hash FROM redacted"""))
def masked_numbers(spark, sf):
    rows = fx.annotated(spark, sf).withColumn("t", dt.redact(F.col("text"), dt.pii_spans(F.col("text"))))
    return rows.select("doc_id", F.sha2(dt.hide_numbers(F.col("t"), F.lit("hidden")), 256).alias("text_hash"))


@register("static_contracts", sql("docs", """SELECT doc_id, CASE WHEN sensitivity >= 4 THEN 'department' WHEN sensitivity = 3 THEN 'project' ELSE 'full' END max_detail,
  CASE WHEN sensitivity >= 3 THEN 'aggregated' ELSE 'full' END numeric_granularity FROM docs"""))
def static_contracts(spark, sf):
    return fx.documents(spark, sf).select("doc_id", po.static_contract(F.col("sensitivity")).alias("c")).select("doc_id", "c.*")


@register("rule_actions", """WITH x AS (SELECT event_id, (['block', 'Watermark', 'allow', 'conditional', 'mask', 'generalize', 'odd'])[event_id % 7 + 1] v, (['redact', 'Anonymize', 'summarize', 'generalize', ''])[event_id % 5 + 1] d FROM events)
SELECT v AS violation, d AS detail, CASE lower(v) WHEN 'block' THEN 'DENY' WHEN 'watermark' THEN 'ALLOW_WITH_WATERMARK' WHEN 'allow' THEN 'ALLOW'
  WHEN 'conditional' THEN CASE lower(d) WHEN 'redact' THEN 'REDACT' WHEN 'anonymize' THEN 'ANONYMIZE' WHEN 'summarize' THEN 'SUMMARIZE' ELSE 'GENERALIZE' END
  WHEN 'mask' THEN 'REDACT' WHEN 'generalize' THEN 'GENERALIZE' ELSE 'ALLOW' END derived, count(*) n FROM x GROUP BY ALL""")
def rule_actions(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "element_at(array('block', 'Watermark', 'allow', 'conditional', 'mask', 'generalize', 'odd'), cast(event_id % 7 as int) + 1) violation",
        "element_at(array('redact', 'Anonymize', 'summarize', 'generalize', ''), cast(event_id % 5 as int) + 1) detail")
    return rows.groupBy("violation", "detail").agg(F.count("*").alias("n")).withColumn(
        "derived", po.derived_action(F.col("violation"), F.col("detail")))


@register("suggested_types", f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(lower(text), ' '), lambda x: x <> '') ws FROM conversations),
x AS (SELECT conv_id, p0 + turn * 1000000 pos, replace(trim(w, {BLANKS}), ' ', '_') et FROM (SELECT conv_id, turn, unnest(ws) w, generate_subscripts(ws, 1) - 1 p0 FROM w)),
d AS (SELECT conv_id, et, min(pos) pos FROM x WHERE et <> '' GROUP BY ALL)
SELECT conv_id, et entity_type, CASE WHEN pos % 2 = 0 THEN 'has_pii' ELSE 'has_hr,has_legal' END flags FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos) <= 10""")
def suggested_types(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("w"))
    raw = unnest(rows, ["conv_id", "turn"], "w", "entity_type").select(
        "conv_id", (F.col("_pos") + F.col("turn") * 1000000).alias("position"), tx.strip("entity_type").alias("entity_type"),
        F.expr("CASE WHEN (_pos + turn * 1000000) % 2 = 0 THEN array('x', 'has_pii') ELSE array('has_hr', 'zz', 'has_legal') END").alias("flags"))
    return po.suggested_types(raw, "conv_id").select("conv_id", "entity_type", F.array_join("flags", ",").alias("flags"))


# ---- domain tables -------------------------------------------------------------------------------------

@register("domain_summary", sql("domains domain_types rules dpick", """SELECT d.domain_code, domain_name, is_active, coalesce(t.n, 0) n_entity_types, coalesce(r.n, 0) n_rules, coalesce(p.n, 0) n_documents
FROM domains d LEFT JOIN (SELECT domain_code, count(*) n FROM domain_types GROUP BY 1) t USING (domain_code) LEFT JOIN (SELECT domain_code, count(*) n FROM rules GROUP BY 1) r USING (domain_code)
LEFT JOIN (SELECT domain_code, count(*) n FROM dpick GROUP BY 1) p USING (domain_code)"""))
def domain_summary(spark, sf):
    def counts(df, name):
        return df.groupBy("domain_code").agg(F.count("*").alias(name))

    labels, types, outside, domains = domain_rows(spark, sf)
    scores = po.domain_scores(labels, types, outside, domains)
    return (
        domains.join(counts(types, "a"), "domain_code", "left").join(counts(fx.rules(spark, sf), "b"), "domain_code", "left")
        .join(counts(scores, "c"), "domain_code", "left")
        .selectExpr("domain_code", "domain_name", "is_active", "coalesce(a, 0) n_entity_types", "coalesce(b, 0) n_rules", "coalesce(c, 0) n_documents"))


@register("entity_types_in_use", sql("domain_types domains ents", """SELECT domain_code, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) entity_types, count(DISTINCT doc_id) n_documents
FROM domain_types JOIN domains USING (domain_code) JOIN ents ON label = entity_type WHERE is_active GROUP BY 1"""))
def entity_types_in_use(spark, sf):
    live = po.active_entity_types(fx.domain_types(spark, sf), fx.domains(spark, sf))
    labels = dt.label_rows(fx.annotated(spark, sf)).withColumnRenamed("label", "entity_type")
    return live.join(labels, "entity_type").groupBy("domain_code").agg(
        F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("entity_types"), F.count_distinct("doc_id").alias("n_documents"))
