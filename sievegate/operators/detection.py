"""Personal data, secrets, entities and sensitivity found in text.

Detection is column work inside the row of the text: nothing is shuffled, and
offsets come from the pieces between matches, so no Python is involved.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import scoring as sc
from sievegate.functions import text as tx
from sievegate.operators.common import unnest

_SPAN = "array<struct<start:int,rank:int,pattern:int,end:int,entity_type:string,text:string,score:double>>"


def any_of(words: list[str]) -> str:
    """Case-blind alternation of plain words, in order."""
    return "(?iuU)" + "|".join(re.sub(r"([.^$*+?()\[\]{}|\\&-])", r"\\\1", w) for w in words)


def match_starts(text: Column, pattern: str, matches: Column) -> Column:
    """0-based start of every match: lengths of the pieces between matches, summed up."""
    pieces = F.split(text, pattern, -1)
    return F.aggregate(
        F.zip_with(
            F.transform(F.slice(pieces, 1, F.size(matches)), F.length),
            F.transform(matches, F.length),
            lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")),
        ),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["size"]).alias("at"),
            F.concat(acc["out"], F.array(acc["at"] + p["gap"])).alias("out"),
        ),
        lambda acc: acc["out"],
    )


# What a text must contain before a pattern can match, as a cheaper test.
_NEEDS_AT = {"EMAIL_ADDRESS", "email"}
_NEEDS_DIGITS = {
    "PHONE_NUMBER", "SALARY_AMOUNT", "CCCD_CMND", "BANK_ACCOUNT", "DATE_OF_BIRTH", "PASSPORT",
    "phone", "national_id", "tax_id", "social_insurance", "bank_account",
}


def find_all(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern, skipping texts that cannot have one."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    if kind in _NEEDS_AT:
        return F.when(text.contains("@"), matches).otherwise(none)
    if kind in _NEEDS_DIGITS:
        return F.when(text.rlike(r"(?U)\d{3}"), matches).otherwise(none)
    return F.coalesce(matches, none)


def _pattern_spans(text: Column, number: int, kind: str, pattern: str, score: float) -> Column:
    """Spans of one pattern; texts without a match stop after one scan."""
    pattern = "(?iuU)" + pattern

    def spans(matches: Column) -> Column:
        rows = F.zip_with(
            match_starts(text, pattern, matches), matches,
            lambda at, m: F.struct(
                at.alias("start"), (-F.length(m)).alias("rank"), F.lit(number).alias("pattern"),
                (at + F.length(m)).alias("end"), F.lit(kind).alias("entity_type"),
                m.alias("text"), F.lit(score).alias("score"),
            ),
        )
        return F.when(F.size(matches) == 0, F.array().cast(_SPAN)).otherwise(rows.cast(_SPAN))

    return tx.let(find_all(text, kind, pattern), spans)


def pii_spans(text: Column) -> Column:
    """All personal data spans by start; of equal spans the earliest pattern stays."""
    found = [
        _pattern_spans(text, number, kind, pattern, score)
        for number, (kind, pattern, score) in enumerate(fixed.PII_PATTERNS)
    ]

    def first_of_equal(spans: Column) -> Column:
        return F.filter(
            spans,
            lambda s, i: (i == 0)
            | (F.element_at(spans, F.greatest(i, F.lit(1)))["start"] != s["start"])
            | (F.element_at(spans, F.greatest(i, F.lit(1)))["end"] != s["end"]),
        )

    return tx.let(F.array_sort(F.flatten(F.array(*found))), first_of_equal)


def has_pii(text: Column) -> Column:
    """Whether a text has a span of `pii_spans`, known at the first match."""
    hit = F.lit(False)
    for kind, pattern, _ in fixed.PII_PATTERNS:
        found = text.rlike("(?iuU)" + pattern)
        if kind in _NEEDS_AT:
            found = text.contains("@") & found
        elif kind in _NEEDS_DIGITS:
            found = text.rlike(r"(?U)\d{3}") & found
        hit = hit | F.coalesce(found, F.lit(False))
    return hit


def apart(spans: Column) -> Column:
    """Spans without overlaps: leftmost first, then the longest, then the earliest pattern."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("until"), F.array().cast(_SPAN).alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["until"],
            F.struct(s["end"].alias("until"), F.concat(acc["out"], F.array(s)).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )


def replace_spans(text: Column, spans: Column, label) -> Column:
    """Rebuild a text with every span replaced by `label(span)`."""
    def rebuild(kept: Column) -> Column:
        parts = F.transform(
            kept,
            lambda s, i: F.concat(
                F.substring(
                    text,
                    F.when(i > 0, F.element_at(kept, F.greatest(i, F.lit(1)))["end"]).otherwise(0) + 1,
                    s["start"] - F.when(i > 0, F.element_at(kept, F.greatest(i, F.lit(1)))["end"])
                    .otherwise(0),
                ),
                label(s),
            ),
        )
        rest = F.substring(text, F.element_at(kept, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(tx.let(apart(spans), rebuild))


def redact(text: Column, spans: Column) -> Column:
    return replace_spans(text, spans, lambda s: F.concat(F.lit("["), s["entity_type"], F.lit("]")))


def anonymize(text: Column, spans: Column) -> Column:
    """Same text, same alias: TYPE-n by first appearance of the value."""
    values = F.array_distinct(F.transform(spans, lambda s: s["text"]))
    return replace_spans(
        text, spans,
        lambda s: F.concat(F.lit("["), s["entity_type"], F.lit("-"),
                           F.array_position(values, s["text"]).cast("string"), F.lit("]")),
    )


def hide_numbers(text: Column, granularity: Column) -> Column:
    """Digits by the asked coarseness: gone, rounded down to powers of ten, or kept."""
    hidden = F.regexp_replace(text, r"\d+(?:[.,]\d+)*", "[#]")
    coarse = F.regexp_replace(text, r"(?<=\d)[0-9]", "0")
    return (
        F.when(granularity == "hidden", hidden)
        .when(granularity.isin("aggregated", "range_only"), coarse).otherwise(text)
    )


def director_redaction(text: Column) -> Column:
    for pattern, mark in fixed.DIRECTOR_REDACTIONS:
        text = F.regexp_replace(text, "(?iuU)" + pattern, mark)
    return text


def mask_for_reader(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Mask personal data by the reader's standing.

    `rows` carry is_corp_member and max_clearance. Top members with level 5 read
    everything, with level 4 all but seven types, everyone else sees no personal
    data.
    """
    scanned = rows.withColumn("_spans", pii_spans(F.col(text_col)))
    top = F.coalesce("is_corp_member", F.lit(False))
    level = F.coalesce("max_clearance", F.lit(1))
    some = F.filter("_spans", lambda s: s["entity_type"].isin(fixed.DIRECTOR_MASK_TYPES))
    masked = scanned.withColumn(
        "_mask",
        F.when(top & (level >= 5), F.array().cast(_SPAN)).when(top & (level >= 4), some)
        .otherwise(F.col("_spans")),
    )
    return masked.withColumn(text_col, redact(F.col(text_col), F.col("_mask"))).withColumn(
        "pii_redacted", F.size("_mask") > 0
    ).withColumn("pii_entities", F.transform("_mask", lambda s: s["entity_type"])).drop("_spans", "_mask")


def secret_hits(text: Column, words: list[str]) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(any_of(words)), F.lit(0)))


def scan_responses(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Personal data and secrets in answers, with the reason that would trigger a judge.

    The reason asks only whether there is a match, so who wants it alone does not pay for the spans.
    """
    blank = tx.strip(text_col) == ""
    out = rows.withColumn(
        "_spans", F.when(blank, F.array().cast(_SPAN)).otherwise(pii_spans(F.col(text_col)))
    ).withColumn("hard_secrets", secret_hits(F.col(text_col), fixed.HARD_SECRETS)).withColumn(
        "soft_secrets", secret_hits(F.col(text_col), fixed.SOFT_SECRETS))
    hard, soft = (F.col(text_col).rlike(any_of(words)) for words in (fixed.HARD_SECRETS, fixed.SOFT_SECRETS))
    return out.withColumn("has_pii", ~F.coalesce(blank, F.lit(False)) & has_pii(F.col(text_col))).withColumn(
        "has_secret", (F.size("hard_secrets") > 0) | (F.size("soft_secrets") > 0)
    ).withColumn(
        "trigger",
        F.when(F.col("has_pii"), "pii").when(hard, "hard_secret").when(soft, "soft_secret").otherwise("none"),
    ).withColumn("redacted_text", redact(F.col(text_col), F.col("_spans"))).drop("_spans")


def decide_responses(scanned: DataFrame) -> DataFrame:
    """block / redact / allow for scanned answers.

    `judge_action` (BLOCK, REDACT, ALLOW or null) is the outside verdict. A top
    member with level 5 is never redacted, and a verdict cannot block them.
    """
    exempt = F.coalesce("is_corp_member", F.lit(False)) & (F.coalesce("max_clearance", F.lit(1)) >= 5)
    verdict = F.when(F.col("trigger") != "none", F.upper("judge_action"))
    return scanned.withColumn(
        "decision",
        F.when(exempt, "allow").when(verdict == "BLOCK", "block")
        .when(F.coalesce(verdict == "ALLOW", F.lit(False)), "allow")
        .when(F.col("has_pii"), "redact").otherwise("allow"),
    )


def injection_pattern(query: Column) -> Column:
    """1-based number of the first injection pattern met; 0 for none."""
    q = F.lower(query)
    hits = F.array(*[q.rlike("(?iuU)" + p) for p in fixed.INJECTION_PATTERNS])
    return F.array_position(hits, True)


def normalize_verdict(raw: Column) -> Column:
    """Intent verdict JSON with unknown values turned to the safe default."""
    v = F.from_json(raw, "action string, risk string, class string, rewrite string, reason string")
    action = F.upper(F.coalesce(v["action"], F.lit("ALLOW")))
    risk = F.upper(F.coalesce(v["risk"], F.lit("LOW")))
    rewrite = F.nullif(v["rewrite"], F.lit(""))
    known = F.when(action.isin("ALLOW", "BLOCK", "REWRITE"), action).otherwise("ALLOW")
    return F.struct(
        F.when((known == "REWRITE") & rewrite.isNull(), "ALLOW").otherwise(known).alias("action"),
        F.when(risk.isin("LOW", "MEDIUM", "HIGH"), risk).otherwise("LOW").alias("risk"),
        F.upper(F.coalesce(v["class"], F.lit("SAFE"))).alias("class"),
        rewrite.alias("rewrite"), F.coalesce(v["reason"], F.lit("")).alias("reason"),
    )


def normalize_judgement(raw: Column) -> Column:
    v = F.from_json(raw, "leaked boolean, severity string, action string, reason string")
    severity = F.upper(F.coalesce(v["severity"], F.lit("LOW")))
    action = F.upper(F.coalesce(v["action"], F.lit("ALLOW")))
    return F.struct(
        F.coalesce(v["leaked"], F.lit(False)).alias("leaked"),
        F.when(severity.isin("HIGH", "MEDIUM", "LOW"), severity).otherwise("LOW").alias("severity"),
        F.when(action.isin("BLOCK", "REDACT", "ALLOW"), action).otherwise("ALLOW").alias("action"),
    )


def block_message(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in fixed.BLOCK_MESSAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(fixed.BLOCK_MESSAGE_DEFAULT))


# ---- structured entities ---------------------------------------------------------------

_ENTITY = "array<struct<label:string,value:string,start:int,end:int>>"


def _label_spans(text: Column, label: str, pattern: str, blind: bool, group: int) -> Column:
    pattern = ("(?iuU)" if blind else "(?U)") + pattern

    def one(at: Column, m: Column) -> Column:
        # In every grouped pattern the group ends the match.
        value = F.regexp_extract(m, pattern, 1) if group else m
        end = at + F.length(m)
        return F.struct(F.lit(label).alias("label"), value.alias("value"),
                        (end - F.length(value)).alias("start"), end.alias("end"))

    def spans(matches: Column) -> Column:
        rows = F.zip_with(match_starts(text, pattern, matches), matches, one)
        return F.when(F.size(matches) == 0, F.array().cast(_ENTITY)).otherwise(rows.cast(_ENTITY))

    return tx.let(find_all(text, label, pattern), spans)


def entities(rows: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, label, value, start, end of every structured entity."""
    found = [_label_spans(F.col(text_col), *rule) for rule in fixed.ENTITY_PATTERNS]
    flat = rows.select(key, F.flatten(F.array(*found)).alias("_e"))
    return unnest(flat, [key], "_e", "e").select(key, "e.label", "e.value", "e.start", "e.end")


def entity_labels(text: Column) -> Column:
    """Labels of the structured entities in a text, without their values."""
    hits = [
        F.when(text.rlike(("(?iuU)" if blind else "(?U)") + pattern), F.lit(label))
        for label, pattern, blind, _ in fixed.ENTITY_PATTERNS
    ]
    return F.array_compact(F.array(*hits))


def label_rows(rows: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct key, label."""
    flat = rows.select(key, entity_labels(F.col(text_col)).alias("_l"))
    return unnest(flat, [key], "_l", "label").select(key, "label")


def flag_map(builtin: DataFrame, configured: DataFrame) -> DataFrame:
    """entity_type, flags: configured rows replace built-in ones."""
    ours = configured.groupBy("entity_type").agg(F.first("flags").alias("_flags"))
    return builtin.join(ours, "entity_type", "full_outer").select(
        "entity_type", F.coalesce("_flags", "flags").alias("flags"))


def boolean_labels(
    rows: DataFrame, flags: DataFrame, key: str = "doc_id", text_col: str = "text",
    extra: DataFrame | None = None,
) -> DataFrame:
    """key, entity_types and the six flags of every text.

    `extra`: key, label from an outside model. Only distinct (key, label, flag)
    facts are grouped, never texts.
    """
    keyword = F.array_compact(
        F.array(*[F.when(F.col(text_col).rlike("(?iuU)" + p), F.lit(f)) for f, p in fixed.KEYWORD_FLAGS]))
    base = rows.select(key, entity_labels(F.col(text_col)).alias("_l"), keyword.alias("_k"))
    facts = unnest(base, [key], "_l", "label").select(key, "label")
    if extra is not None:
        facts = facts.unionByName(extra.select(key, "label")).distinct()
    known = flags.select(F.col("entity_type").alias("label"), "flags")
    grouped = facts.join(known, "label", "left").groupBy(key).agg(
        F.array_sort(F.collect_set("label")).alias("entity_types"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("flags", F.array().cast("array<string>")))))
        .alias("_f"),
    )
    joined = base.select(key, "_k").join(grouped, key, "left").withColumn(
        "_all", F.concat("_k", F.coalesce("_f", F.array().cast("array<string>"))))
    return joined.select(
        key, F.coalesce("entity_types", F.array().cast("array<string>")).alias("entity_types"),
        *[F.array_contains("_all", f).alias(f) for f in fixed.FLAGS],
    )


def chunk_sensitivity(document_level: Column) -> Column:
    """Level of a chunk from its document's level and the six flag columns."""
    any_flag, weight = F.lit(False), F.lit(0)
    for flag in fixed.FLAGS:
        any_flag = any_flag | F.col(flag)
        weight = weight + F.when(F.col(flag), fixed.FLAG_WEIGHTS[flag]).otherwise(0)
    delta = F.when(any_flag, F.least(weight, F.lit(2))).otherwise(-1)
    return sc.clamp_level(document_level + delta)


def classify_sensitivity(stored: Column, text: Column) -> Column:
    """Stored level when valid, else the highest level whose patterns occur, else 1."""
    scan = F.lit(1)
    for level in sorted(fixed.LEVEL_PATTERNS):
        pattern = "(?iuU)" + "|".join(f"(?:{p})" for p in fixed.LEVEL_PATTERNS[level])
        scan = F.when(text.rlike(pattern), level).otherwise(scan)
    given = stored.try_cast("int")
    return F.when(given.between(fixed.MIN_LEVEL, fixed.MAX_LEVEL), given).otherwise(scan)


def resync_levels(
    chunks: DataFrame, changes: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """New chunk levels after documents changed level.

    `chunks`: chunk_id, key, llm_chunk_sensitivity; `changes`: key, old_sensitivity,
    new_sensitivity. The distance to the old level is kept where it is known.
    """
    moved = chunks.join(changes, key)
    return moved.withColumn(
        "chunk_sensitivity",
        F.when(
            F.col("llm_chunk_sensitivity").isNotNull(),
            sc.clamp_level(
                F.col("new_sensitivity") + F.col("llm_chunk_sensitivity") - F.col("old_sensitivity")),
        ).otherwise(F.col("new_sensitivity")),
    )
