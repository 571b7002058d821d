"""Policy evaluation: intent, risk, domains, rules, contracts and their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import scoring as sc
from sievegate.operators import detection as dt
from sievegate.operators.common import salted_join, top_k
from sievegate.session import shared_dir

GLOBAL = "GLOBAL"
RULES_BROADCAST = 10_000


# ---- intent and risk ---------------------------------------------------------------

def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in dict.fromkeys(words):
        hit = hit | text.contains(w)
    return hit


def intent_class(query: Column) -> Column:
    """First intent whose keywords occur; lookup otherwise."""
    q = F.lower(query)
    out = F.lit("lookup")
    for name, words in reversed(fixed.INTENT_KEYWORDS):
        out = F.when(contains_any(q, words), name).otherwise(out)
    return out


def is_ambiguous(query: Column) -> Column:
    return (intent_class(query) == "lookup") & query.rlike("(?iuU)" + fixed.AMBIGUOUS_QUERY)


def other_department(own: Column, other: Column) -> Column:
    own, other = F.coalesce(own, F.lit("")), F.coalesce(other, F.lit(""))
    return (own != "") & (other != "") & (F.lower(own) != F.lower(other))


def intent_risk(
    intent: Column, query: Column, own_department: Column, item_department: Column,
    user_level: Column, item_level: Column, off_hours: Column,
) -> Column:
    """struct(score, signal, reasoning) of a query against one item."""
    crossing = other_department(own_department, item_department)
    gap = item_level - user_level
    bonus = F.least(F.lit(0.35), 0.15 * gap)
    keyword = contains_any(F.lower(query), fixed.RISK_KEYWORDS)
    parts = [
        (intent == "export", F.lit(0.4), F.lit("export_intent(+0.4)")),
        (intent.isin("aggregate", "compare"), F.lit(0.2), F.lit("aggregate/compare_intent(+0.2)")),
        (crossing, F.lit(0.25), F.lit("cross_department(+0.25)")),
        (gap > 0, bonus, F.concat(F.lit("level_gap="), gap.cast("string"), F.lit("(+"),
                                  F.format_number(bonus, 2), F.lit(")"))),
        (off_hours, F.lit(0.1), F.lit("off_hours(+0.1)")),
        (keyword, F.lit(0.15), F.lit("sensitive_keyword(+0.15)")),
    ]
    total = F.lit(0.0)
    for test, value, _ in parts:
        total = total + F.when(test, value).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), total), 3)
    signal = (
        F.when(score >= 0.7, "suspicious").when((intent == "export") & crossing, "bulk_extraction")
        .when(crossing, "cross_dept").otherwise("normal")
    )
    reasons = F.array_join(F.array_compact(F.array(*[F.when(t, r) for t, _, r in parts])), "; ")
    return F.struct(
        score.alias("score"), signal.alias("signal"),
        F.when(reasons == "", "no_risk_factors").otherwise(reasons).alias("reasoning"),
    )


def effective_level(declared: Column, domain_base: Column, pii: Column) -> Column:
    """Name of the highest of declared level, domain level and the personal data floor."""
    def from_number(n: Column) -> Column:
        return F.when(n.between(1, 5), n - 1).otherwise(1)

    floor = F.when(pii, fixed.LEVEL_NAMES.index("Confidential")).otherwise(0)
    return sc.level_name(F.greatest(from_number(declared), from_number(domain_base), floor))


# ---- domains ----------------------------------------------------------------------------

def active_entity_types(types: DataFrame, domains: DataFrame) -> DataFrame:
    return types.join(domains.where("is_active"), "domain_code", "left_semi")


def domain_scores(
    labels: DataFrame, types: DataFrame, outside: DataFrame, domains: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """key, domain_code, confidence: domains over the threshold, else the outside favourite.

    `labels`: key, label (distinct); `outside`: key, domain_code, confidence. Only
    domains that share an entity type with the item or have an outside score are
    looked at; all others score 0.
    """
    active = domains.where("is_active").select("domain_code")
    live = types.join(active, "domain_code", "left_semi").select("domain_code", "entity_type").distinct()
    sizes = live.groupBy("domain_code").agg(F.count("*").alias("_size"))
    overlap = (
        labels.join(live.select("domain_code", F.col("entity_type").alias("label")), "label")
        .groupBy(key, "domain_code").agg(F.count("*").alias("_both")).join(sizes, "domain_code")
        .select(key, "domain_code", (F.col("_both") / F.col("_size")).alias("_overlap"))
    )
    given = outside.join(active, "domain_code", "left_semi").select(
        key, "domain_code",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("_given"))
    scored = given.join(overlap, [key, "domain_code"], "full_outer").withColumn(
        "confidence",
        F.round(fixed.DOMAIN_EXTERNAL_WEIGHT * F.coalesce("_given", F.lit(0.0))
                + fixed.DOMAIN_OVERLAP_WEIGHT * F.coalesce("_overlap", F.lit(0.0)), 3),
    )
    everyone = Window.partitionBy(key)
    marked = scored.withColumn(
        "_any", F.max(F.col("confidence") >= fixed.DOMAIN_THRESHOLD).over(everyone)
    ).withColumn(
        "_best",
        F.row_number().over(everyone.orderBy(F.col("_given").desc_nulls_last(), F.col("domain_code").asc())),
    )
    over = marked.where(F.col("confidence") >= fixed.DOMAIN_THRESHOLD)
    lone = marked.where(~F.col("_any") & (F.col("_best") == 1)).withColumn(
        "domain_code", F.when(F.col("_given").isNull(), "GEN-00").otherwise(F.col("domain_code"))
    ).withColumn("confidence", F.coalesce(F.round("_given", 3), F.lit(1.0)))
    return over.unionByName(lone).select(key, "domain_code", "confidence")


def primary_domain(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    order = [F.col("confidence").desc(), F.col("domain_code").asc()]
    return top_k(scores, [key], order, 1).drop("rank")


# ---- rules ------------------------------------------------------------------------------

def rule_candidates(contexts: DataFrame, scopes: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Applicable rules per context with their score.

    `contexts`: key, role, effective_level, effective_clearance, intent, own_department,
    item_department, user_levels, item_level, primary_domain; `scopes`: key, domain_code.
    Global rules have a scope of their own, so that every match is an equi-join. Rules are counted: up to
    `RULES_BROADCAST` go to every task, more of them meet the contexts in salted parts, because every
    context has the global scope.
    """
    reach = scopes.select(key, F.col("domain_code").alias("scope")).unionByName(
        contexts.select(key, F.lit(GLOBAL).alias("scope")))
    live = rules.where("is_active").withColumn("scope", F.coalesce("domain_code", F.lit(GLOBAL)))
    live, scoped = live.drop("domain_code"), contexts.join(reach, key)
    few = live.limit(RULES_BROADCAST + 1).count() <= RULES_BROADCAST
    met = scoped.join(F.broadcast(live), "scope") if few else salted_join(scoped, live, ["scope"], key)

    role = F.col("role")
    exempt = F.array_contains("exempt_roles", role)
    forced = F.array_contains("forced_roles", role)
    level_ok = F.col("min_sensitivity").isNull() | (
        sc.level_rank("effective_level") >= sc.level_rank("min_sensitivity"))
    clearance_ok = F.coalesce("min_clearance", F.lit(0)).eqNullSafe(0) | (
        F.col("effective_clearance") < F.col("min_clearance"))
    intent_ok = (F.size("intents") == 0) | F.array_contains("intents", F.col("intent"))
    by_level = F.col("item_level").isNotNull() & (F.size(F.coalesce("user_levels", F.array().cast("array<int>"))) > 0)
    same = F.lower(F.coalesce("own_department", F.lit(""))) == F.lower(F.coalesce("item_department", F.lit("")))
    crosses = F.when(
        by_level, ~F.exists("user_levels", lambda u: u <= F.col("item_level"))
    ).otherwise(
        ~((F.coalesce("own_department", F.lit("")) != "") & (F.coalesce("item_department", F.lit("")) != "") & same))
    department_ok = ~F.col("cross_dept_only") | crosses

    open_rule = (F.size("forced_roles") == 0) & (F.size("exempt_roles") == 0)
    score = F.when(
        forced, F.when(F.col("mandatory"), 1.0).otherwise(0.95)
    ).otherwise(
        F.least(F.lit(1.0), F.when(open_rule, 0.6).otherwise(0.8) + F.when(F.col("mandatory"), 0.2).otherwise(0.0)))
    reasons = F.when(
        forced, F.concat(F.when(F.col("mandatory"), "mandatory,").otherwise(""), F.lit("role_force_applied"))
    ).otherwise(
        F.concat(F.lit("sensitivity_ok,conditions_ok,role_neutral"),
                 F.when(F.col("mandatory"), ",mandatory").otherwise("")))
    return met.where(
        ~exempt & (forced | (level_ok & clearance_ok & intent_ok & department_ok))
    ).select(
        key, "rule_code", "action", "priority", "mandatory", "max_detail", "numeric_granularity",
        F.when(F.col("scope") == GLOBAL, GLOBAL).otherwise(F.col("primary_domain")).alias("domain"),
        F.round(score, 3).alias("score"), reasons.alias("reasons"),
    )


def select_rules(contexts: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Selected rules per context; a default-allow row where nothing applies."""
    chosen = candidates.where((F.col("score") >= fixed.RULE_SCORE_THRESHOLD) | F.col("mandatory"))
    none = contexts.select(key).join(chosen.select(key).distinct(), key, "left_anti").select(
        key, F.lit("FALLBACK").alias("rule_code"), F.lit("allow").alias("action"),
        F.lit(0).alias("priority"), F.lit(False).alias("mandatory"),
        F.lit("summarize").alias("max_detail"), F.lit("exact").alias("numeric_granularity"),
        F.lit(GLOBAL).alias("domain"), F.lit(1.0).alias("score"), F.lit("no_rule_match").alias("reasons"),
    )
    return chosen.unionByName(none)


def keep_relevant(selected: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """Selected rules named relevant (key, rule_code) plus mandatory ones.

    A context keeps all its rules when nothing would be left, when it has one
    rule, or when it has no relevance rows at all.
    """
    judged = relevant.select(key).distinct().withColumn("_judged", F.lit(True))
    named = relevant.select(key, "rule_code").distinct().withColumn("_named", F.lit(True))
    everyone = Window.partitionBy(key)
    rows = selected.join(judged, key, "left").join(named, [key, "rule_code"], "left")
    keep = F.col("mandatory") | F.col("_named").isNotNull()
    return rows.withColumn("_keep", keep).withColumn("_n", F.count("*").over(everyone)).withColumn(
        "_some", F.max("_keep").over(everyone)
    ).where(F.col("_judged").isNull() | (F.col("_n") == 1) | ~F.col("_some") | F.col("_keep")).drop(
        "_judged", "_named", "_keep", "_n", "_some")


def _strictest(column: str, order: dict[str, int]) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    value = F.coalesce(rank[F.coalesce(F.col(column), F.lit(""))], F.lit(0))
    # By order; of equals the smaller rule code, as the first one in the rule list.
    return F.when(F.col("action") == "conditional", F.struct(-value, F.col("rule_code")))


def resolve_conflicts(selected: DataFrame, key: str) -> DataFrame:
    """One decision per context: block, then merged conditions, then watermark, then allow."""
    def has(action: str) -> Column:
        return F.bool_or(F.col("action") == action)

    def winner(action: str) -> Column:
        rank = F.when(F.col("action") == action, F.struct(-F.col("priority"), F.col("rule_code")))
        return F.min_by("rule_code", rank)

    grouped = selected.groupBy(key).agg(
        *[has(a).alias(f"_{a}") for a in ("block", "conditional", "watermark", "allow")],
        *[winner(a).alias(f"_w_{a}") for a in ("block", "conditional", "watermark", "allow")],
        F.min_by("max_detail", _strictest("max_detail", fixed.DETAIL_ORDER)).alias("_detail"),
        F.min_by("numeric_granularity", _strictest("numeric_granularity", fixed.NUMERIC_ORDER)).alias("_numeric"),
        F.count("*").alias("n_rules"),
        F.array_join(F.array_sort(F.collect_list("rule_code")), ",").alias("applied_rules"),
    )

    def pick(block, conditional, watermark, allow, other) -> Column:
        return (
            F.when(F.col("_block"), block).when(F.col("_conditional"), conditional)
            .when(F.col("_watermark"), watermark).when(F.col("_allow"), allow).otherwise(other)
        )

    none = F.lit(None).cast("string")
    return grouped.select(
        key,
        pick("block", "conditional", "watermark", "allow", "block").alias("decision"),
        pick("block_overrides", "conditional_merged", "watermark_only", "allow_only", "fallback_deny")
        .alias("decision_reason"),
        pick(F.col("_w_block"), F.col("_w_conditional"), F.col("_w_watermark"), F.col("_w_allow"), none)
        .alias("winning_rule"),
        pick(F.lit("generalize"), F.coalesce("_detail", F.lit("generalize")), F.lit("generalize"),
             F.lit("generalize"), F.lit("summarize")).alias("max_detail"),
        pick(F.lit("aggregated"), F.coalesce("_numeric", F.lit("aggregated")), F.lit("aggregated"),
             F.lit("aggregated"), F.lit("exact")).alias("numeric_granularity"),
        (F.col("n_rules") > fixed.MAX_RULES_BEFORE_REVIEW).alias("needs_human_review"),
        "n_rules", "applied_rules",
    )


def contracts(
    contexts: DataFrame, labels: DataFrame, types: DataFrame, outside: DataFrame, domains: DataFrame,
    rules: DataFrame, key: str = "doc_id", relevant: DataFrame | None = None,
) -> DataFrame:
    """Policy contract per context.

    `contexts`: key, query, role, own_department, item_department, user_level,
    declared_level, effective_clearance, off_hours.
    """
    shared_dir(contexts.sparkSession)
    # A few rows per context, read by several joins below.
    scores = domain_scores(labels, types, outside, domains, key).checkpoint()
    main = primary_domain(scores, key).withColumnRenamed("domain_code", "primary_domain").drop("confidence")
    base = domains.select(F.col("domain_code").alias("primary_domain"), "base_sensitivity")
    full = (
        contexts.join(main, key, "left").join(base, "primary_domain", "left")
        .withColumn("primary_domain", F.coalesce("primary_domain", F.lit("GEN-00")))
        .withColumn("intent", intent_class(F.col("query")))
        .withColumn("effective_level", effective_level(
            F.col("declared_level"), F.coalesce("base_sensitivity", F.lit(2)), F.lit(False)))
        .withColumn("user_levels", F.array().cast("array<int>"))
        .withColumn("item_level", F.lit(None).cast("int"))
        .withColumn("_risk", intent_risk(
            F.col("intent"), F.col("query"), F.col("own_department"), F.col("item_department"),
            F.col("user_level"), F.lit(1), F.col("off_hours")))
    )
    candidates = rule_candidates(full, scores.select(key, "domain_code"), rules, key)
    selected = select_rules(full, candidates, key)
    decided = resolve_conflicts(selected, key)
    if relevant is not None:
        # Review is judged on all selected rules, the decision on the relevant ones.
        review = decided.select(key, "needs_human_review")
        decided = resolve_conflicts(keep_relevant(selected, relevant, key), key).drop(
            "needs_human_review").join(review, key)
    listed = scores.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list("domain_code")), ",").alias("domains"))
    out = full.join(decided, key).join(listed, key, "left")
    return out.select(
        F.concat(F.lit("PC-"), F.substring(
            F.sha2(F.concat_ws("|", F.col(key), "query", "role"), 256), 1, 12)).alias("contract_id"),
        key, "domains", "primary_domain", "effective_level", "intent", "decision", "decision_reason",
        "max_detail", "numeric_granularity", "winning_rule", "applied_rules", "n_rules",
        "needs_human_review", F.col("_risk.score").alias("risk_score"),
        F.col("_risk.signal").alias("risk_signal"), F.col("_risk.reasoning").alias("risk_reasoning"),
    )


# ---- effect ---------------------------------------------------------------------------------

def enforce(rows: DataFrame, decided: DataFrame, key: str, text_col: str = "text", masks: bool = False) -> DataFrame:
    """Apply decisions to texts; `rows` carry is_corp_member.

    Top members see rows unchanged and blocked rows go. Conditions put the notice
    of their kind in place of the text, or with `masks` mask what they can.
    """
    met = rows.join(decided.select(key, "decision", "max_detail", "numeric_granularity"), key, "left")
    text, detail = F.col(text_col), F.coalesce("max_detail", F.lit("generalize"))
    notice = F.lit(fixed.TRANSFORM_NOTICES["generalize"])
    for kind, words in fixed.TRANSFORM_NOTICES.items():
        notice = F.when(detail == kind, words).otherwise(notice)
    if masks:
        spans = dt.pii_spans(text)
        notice = (
            F.when(detail == "redact", dt.hide_numbers(dt.redact(text, spans), F.col("numeric_granularity")))
            .when(detail == "anonymize", dt.anonymize(text, spans)).otherwise(notice)
        )
    top = F.coalesce("is_corp_member", F.lit(False))
    decision = F.coalesce("decision", F.lit("allow"))
    return met.where(top | (decision != "block")).withColumn(
        text_col,
        F.when(top | (text == ""), text)
        .when(decision == "conditional", notice)
        .when(decision == "watermark", F.concat(text, F.lit(fixed.WATERMARK_SUFFIX)))
        .otherwise(text),
    )


def applied_rules(selected: DataFrame, decided: DataFrame, key: str, group: str) -> DataFrame:
    """Distinct rules per group whose action made the final decision, other than allow."""
    return (
        selected.join(decided.select(key, "decision"), key)
        .where((F.col("decision") != "allow") & (F.col("action") == F.col("decision")))
        .select(group, "rule_code", "action").distinct()
    )


def restricted_results(rows: DataFrame, group: str, text_col: str = "text") -> DataFrame:
    """Whether any and whether all results of a group were hidden."""
    hidden = F.col(text_col) == fixed.REDACT_NOTICE
    return rows.groupBy(group).agg(
        F.bool_or(hidden).alias("has_restricted"), F.bool_and(hidden).alias("all_restricted"))


def static_contract(level: Column) -> Column:
    return F.struct(
        F.when(level >= 4, "department").when(level == 3, "project").otherwise("full").alias("max_detail"),
        F.when(level >= 3, "aggregated").otherwise("full").alias("numeric_granularity"),
    )


def derived_action(violation: Column, detail: Column) -> Column:
    v, d = F.lower(violation), F.lower(F.coalesce(detail, F.lit("")))
    conditional = (
        F.when(d == "redact", "REDACT").when(d == "anonymize", "ANONYMIZE")
        .when(d == "summarize", "SUMMARIZE").otherwise("GENERALIZE")
    )
    return (
        F.when(v == "block", "DENY").when(v == "watermark", "ALLOW_WITH_WATERMARK")
        .when(v == "allow", "ALLOW").when(v == "conditional", conditional)
        .when(v == "mask", "REDACT").when(v == "generalize", "GENERALIZE").otherwise("ALLOW")
    )


def suggested_types(raw: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Clean suggested entity types: `raw` has key, position, entity_type, flags.

    Snake case, known flags only, first of equal names, first ten per key.
    """
    clean = raw.withColumn(
        "entity_type", F.replace(F.lower(F.trim("entity_type")), F.lit(" "), F.lit("_"))
    ).where("entity_type <> ''")
    first = top_k(clean, [key, "entity_type"], [F.col("position").asc()], 1).drop("rank")
    known = F.array(*[F.lit(f) for f in fixed.FLAGS])
    best = top_k(first, [key], [F.col("position").asc()], limit)
    return best.withColumn("flags", F.filter("flags", lambda f: F.array_contains(known, f)))
