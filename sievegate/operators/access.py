"""Organisation graph and access rules.

Tables: edges (oui_id, parent_oui_id), positions held (user_id, oui_id, clearance),
documents (doc_id, owner_user_id, sensitivity), document_nodes (doc_id, oui_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.operators import detection as dt
from sievegate.operators.common import salted_join, top_k, unnest
from sievegate.session import shared_dir

PROFILES_BROADCAST = 100_000  # profiles that go to every task


# ---- graph -----------------------------------------------------------------------

def closure(edges: DataFrame) -> DataFrame:
    """oui_id, ancestor_id for every pair connected upwards.

    One round per level; only new pairs move on, so several parents and even
    cycles end. Each round is checkpointed to the shared folder.
    """
    shared_dir(edges.sparkSession)
    parents = edges.select("oui_id", F.col("parent_oui_id").alias("ancestor_id")).distinct()
    reached = frontier = parents.checkpoint()
    while True:
        up = parents.select(F.col("oui_id").alias("ancestor_id"), F.col("ancestor_id").alias("_up"))
        step = (
            frontier.join(up, "ancestor_id").select("oui_id", F.col("_up").alias("ancestor_id"))
            .distinct().join(reached, ["oui_id", "ancestor_id"], "left_anti").checkpoint()
        )
        if step.isEmpty():
            return reached
        reached, frontier = reached.unionByName(step), step


def roots(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """oui_id, root_id: the ancestor without parents; itself for a top node."""
    tops = nodes.select("oui_id").join(edges.select("oui_id"), "oui_id", "left_anti")
    above = pairs.join(
        tops.select(F.col("oui_id").alias("ancestor_id")), "ancestor_id", "left_semi"
    ).groupBy("oui_id").agg(F.min("ancestor_id").alias("root_id"))
    return nodes.select("oui_id").join(above, "oui_id", "left").select(
        "oui_id", F.coalesce("root_id", "oui_id").alias("root_id")
    )


def branch_nodes(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """user_id, oui_id: own nodes with everything above and below them."""
    own = held.select("user_id", "oui_id")
    up = own.join(pairs, "oui_id").select("user_id", F.col("ancestor_id").alias("oui_id"))
    down = own.select("user_id", F.col("oui_id").alias("ancestor_id")).join(
        pairs, "ancestor_id"
    ).select("user_id", "oui_id")
    return own.unionByName(up).unionByName(down).distinct()


def branch_conflicts(wanted: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """Wanted (user_id, oui_id) that equal, contain or lie under a held node."""
    same = wanted.select("user_id", "oui_id", F.col("oui_id").alias("held_oui_id"))
    above = wanted.join(pairs, "oui_id").select(
        "user_id", "oui_id", F.col("ancestor_id").alias("held_oui_id"))
    below = wanted.select("user_id", F.col("oui_id").alias("ancestor_id")).join(
        pairs.withColumnRenamed("oui_id", "held_oui_id"), "ancestor_id"
    ).select("user_id", F.col("ancestor_id").alias("oui_id"), "held_oui_id")
    return (
        same.unionByName(above).unionByName(below)
        .join(held.select("user_id", F.col("oui_id").alias("held_oui_id")), ["user_id", "held_oui_id"], "left_semi")
        .groupBy("user_id", "oui_id").agg(F.min("held_oui_id").alias("held_oui_id"))
    )


def invalid_assignments(held: DataFrame, positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Held places whose position belongs to another node type."""
    return (
        held.join(nodes.select("oui_id", F.col("ou_id").alias("node_type")), "oui_id")
        .join(positions.select("position_id", F.col("ou_id").alias("position_type")), "position_id")
        .where("node_type <> position_type")
    )


def profiles(
    held: DataFrame, nodes: DataFrame, types: DataFrame, users: DataFrame | None = None,
) -> DataFrame:
    """user_id, max_clearance (at least 1), is_corp_member, n_positions.

    With `users`, those without a position are there too: level 1, no member, no positions.
    """
    typed = held.join(nodes.select("oui_id", "ou_id"), "oui_id").join(
        types.select("ou_id", "parent_ou_id"), "ou_id"
    )
    found = typed.groupBy("user_id").agg(
        F.greatest(F.lit(1), F.max("clearance")).alias("max_clearance"),
        F.bool_or(F.col("parent_ou_id").isNull()).alias("is_corp_member"),
        F.count("*").alias("n_positions"),
    )
    if users is None:
        return found
    return users.select("user_id").distinct().join(found, "user_id", "left").na.fill(
        {"max_clearance": 1, "is_corp_member": False, "n_positions": 0})


def with_profiles(rows: DataFrame, profile: DataFrame, id_col: str) -> DataFrame:
    """Rows (user_id, `id_col`) that have a profile, with it, in the tasks where the rows lie.

    Few users may have most rows, so rows are not dealt by user: profiles of the users that occur go to
    every task when they are counted to be few, else rows and profiles meet in salted parts.
    """
    asked = profile.join(rows.select("user_id").distinct(), "user_id", "left_semi")
    if asked.limit(PROFILES_BROADCAST + 1).count() <= PROFILES_BROADCAST:
        return rows.join(F.broadcast(asked), "user_id")
    return salted_join(rows, profile, ["user_id"], id_col)


def corp_members(held: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Users with a place in a top-level organisation type."""
    top = nodes.join(types.where("parent_ou_id IS NULL"), "ou_id", "left_semi")
    return held.join(top, "oui_id", "left_semi").select("user_id").distinct()


def changed_parents(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parent links that went or came, with the change named."""
    removed = before.exceptAll(after).withColumn("change", F.lit("removed"))
    return removed.unionByName(after.exceptAll(before).withColumn("change", F.lit("added")))


# ---- relation tuples -----------------------------------------------------------------

def document_tuples(
    docs: DataFrame, doc_nodes: DataFrame, nodes: DataFrame, edges: DataFrame, pairs: DataFrame
) -> DataFrame:
    """doc_id, subject, relation, required_clearance; at most a few rows per document node.

    Ancestors stay folded in `ancestor_member` subjects; only level-1 documents
    list descendants.
    """
    level = F.coalesce("sensitivity", F.lit(1))
    placed = docs.select("doc_id", level.alias("level")).join(doc_nodes, "doc_id").withColumn(
        "required_clearance", F.least("level", F.lit(fixed.MAX_LEVEL))
    )

    def grant(rows: DataFrame, node: str, kind: str, relation: str) -> DataFrame:
        return rows.select(
            "doc_id", F.concat(F.lit("oui:"), F.col(node), F.lit("#" + kind)).alias("subject"),
            F.lit(relation).alias("relation"), "required_clearance",
        )

    owner = docs.where("owner_user_id IS NOT NULL").select(
        "doc_id", F.concat(F.lit("user:"), F.col("owner_user_id")).alias("subject"),
        F.lit("owner").alias("relation"), F.lit(0).alias("required_clearance"),
    )
    members = grant(placed, "oui_id", "member", "viewer")
    upper = grant(placed.join(edges, "oui_id"), "parent_oui_id", "ancestor_member", "viewer")
    editors = grant(placed.join(roots(nodes, edges, pairs), "oui_id"), "root_id", "member", "editor")
    lower = grant(
        placed.where("level = 1").withColumnRenamed("oui_id", "ancestor_id").join(
            pairs, "ancestor_id"),
        "oui_id", "member", "viewer",
    )
    return (
        owner.unionByName(members).unionByName(upper).unionByName(editors).unionByName(lower)
        .groupBy("doc_id", "subject", "relation").agg(F.min("required_clearance").alias("required_clearance"))
    )


def group_subjects(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """user_id, subject: every subject a user counts as through a position."""
    own = held.select("user_id", "oui_id").distinct()
    below = own.select("user_id", F.col("oui_id").alias("ancestor_id")).join(
        pairs, "ancestor_id").select("user_id", "oui_id")
    member = own.select("user_id", F.concat(F.lit("oui:"), "oui_id", F.lit("#member")).alias("subject"))
    ancestor = own.unionByName(below).select(
        "user_id", F.concat(F.lit("oui:"), "oui_id", F.lit("#ancestor_member")).alias("subject")
    ).distinct()
    return member.unionByName(ancestor)


def user_subjects(users: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """user_id, subject: every subject a user counts as, the user in person included."""
    person = users.select("user_id", F.concat(F.lit("user:"), F.col("user_id")).alias("subject")).distinct()
    return group_subjects(held, pairs).unionByName(person)


def viewable_documents(
    users: DataFrame, tuples: DataFrame, held: DataFrame, pairs: DataFrame, clearance: DataFrame
) -> DataFrame:
    """user_id, doc_id, can_edit for the given users.

    Subjects near the root stand in a tuple of every document, so tuples are
    salted by document before they meet the users of that subject.
    """
    asking = users.select("user_id").distinct()
    subjects = user_subjects(asking, held.join(asking, "user_id", "left_semi"), pairs).join(
        clearance.select("user_id", "max_clearance"), "user_id", "left")
    level = F.coalesce("max_clearance", F.lit(1))
    met = salted_join(tuples, subjects, ["subject"], "doc_id").where(
        (F.col("relation") == "owner") | (level >= F.col("required_clearance"))
    )
    return met.groupBy("user_id", "doc_id").agg(
        F.bool_or(F.col("relation").isin("owner", "editor")).alias("can_edit")
    )


def view_summary(
    users: DataFrame, docs: DataFrame, tuples: DataFrame, held: DataFrame, pairs: DataFrame, clearance: DataFrame,
) -> DataFrame:
    """user_id, n_view, n_edit, id_sum for every user who may view a document.

    Users with the same subjects and level see the same documents but for their own. Documents are
    listed once per such class, of which the organisation has few, and never per user; own
    documents are added where the class does not see or edit them.
    """
    subjects = group_subjects(held.join(users.select("user_id"), "user_id", "left_semi"), pairs)
    marks = subjects.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("subject")).alias("_x"),
        F.sum(F.xxhash64("subject").cast("decimal(38,0)")).alias("_s"))
    marked = marks.join(clearance.select("user_id", "max_clearance"), "user_id", "left").withColumn(
        "max_clearance", F.coalesce("max_clearance", F.lit(1)))
    same = ["_n", "_x", "_s", "max_clearance"]
    named = marked.groupBy(*same).agg(F.min("user_id").alias("class_id"))
    classes = marked.join(named, same).select("user_id", "class_id")
    heads = named.select(F.col("class_id").alias("user_id"))
    seen = viewable_documents(heads, tuples.where("relation <> 'owner'"), held, pairs, clearance)
    sums = seen.groupBy(F.col("user_id").alias("class_id")).agg(
        F.count(F.lit(1)).alias("n_view"), F.count_if("can_edit").alias("n_edit"), F.sum("doc_id").alias("id_sum"))
    own = docs.select(F.col("owner_user_id").alias("user_id"), "doc_id").join(
        users.select("user_id"), "user_id", "left_semi").join(classes, "user_id", "left")
    theirs = seen.select(F.col("user_id").alias("class_id"), "doc_id", "can_edit")
    more = own.join(theirs, ["class_id", "doc_id"], "left").groupBy("user_id").agg(
        F.count_if(F.col("can_edit").isNull()).alias("_view"),
        F.count_if(~F.coalesce("can_edit", F.lit(False))).alias("_edit"),
        F.sum(F.when(F.col("can_edit").isNull(), F.col("doc_id")).otherwise(0)).alias("_ids"))
    total = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(a)
    return users.select("user_id").join(classes.join(sums, "class_id"), "user_id", "left").join(
        more, "user_id", "left").select(
        "user_id", total("n_view", "_view"), total("n_edit", "_edit"), total("id_sum", "_ids")).where("n_view > 0")


def access_of_pairs(
    wanted: DataFrame, docs: DataFrame, doc_nodes: DataFrame, nodes: DataFrame, edges: DataFrame,
    pairs: DataFrame, held: DataFrame, clearance: DataFrame,
) -> DataFrame:
    """can_view and can_edit for given (user_id, doc_id) rows only.

    Tuples are derived for the documents in question and meet subjects on
    (user, subject), a key without hot values.
    """
    asked = wanted.select("user_id", "doc_id").distinct()
    ids = asked.select("doc_id").distinct()
    tuples = document_tuples(
        docs.join(ids, "doc_id", "left_semi"), doc_nodes.join(ids, "doc_id", "left_semi"),
        nodes, edges, pairs,
    )
    subjects = group_subjects(
        held.join(asked.select("user_id").distinct(), "user_id", "left_semi"), pairs)
    owner = asked.join(docs.select("doc_id", "owner_user_id"), "doc_id").where(
        "user_id = owner_user_id").select("user_id", "doc_id", F.lit("owner").alias("relation"))
    met = (
        asked.join(tuples.where("relation <> 'owner'"), "doc_id")
        .join(subjects, ["user_id", "subject"], "left_semi")
        .join(clearance.select("user_id", "max_clearance"), "user_id")
        .where("max_clearance >= required_clearance")
        .select("user_id", "doc_id", "relation").unionByName(owner)
    )
    found = met.groupBy("user_id", "doc_id").agg(
        F.bool_or(F.col("relation").isin("owner", "editor")).alias("_edit"))
    return asked.join(found, ["user_id", "doc_id"], "left").select(
        "user_id", "doc_id", F.col("_edit").isNotNull().alias("can_view"),
        F.coalesce("_edit", F.lit(False)).alias("can_edit"),
    )


def tuple_changes(stored: DataFrame, current: DataFrame, touched: DataFrame) -> DataFrame:
    """Tuples to delete and to write for the documents in `touched` (doc_id)."""
    keys = ["doc_id", "subject", "relation", "required_clearance"]
    ids = touched.select("doc_id").distinct()
    old = stored.join(ids, "doc_id", "left_semi").select(keys)
    new = current.join(ids, "doc_id", "left_semi").select(keys)
    gone = old.join(new, keys, "left_anti").withColumn("change", F.lit("delete"))
    return gone.unionByName(new.join(old, keys, "left_anti").withColumn("change", F.lit("write")))


# ---- clearance ------------------------------------------------------------------------

def effective_clearance(
    wanted: DataFrame, held: DataFrame, item_nodes: DataFrame, pairs: DataFrame, item: str = "doc_id"
) -> DataFrame:
    """Clearance of a user towards an item by the nearest relation of their nodes.

    Same node, else the lowest of places below the item, else the highest of
    places above it, else 1. Items without nodes count with the user's best place.
    """
    rows = wanted.select("user_id", item).distinct().join(
        held.select("user_id", F.col("oui_id").alias("_at"), "clearance"), "user_id"
    )
    met = rows.join(item_nodes.select(item, F.col("oui_id").alias("_node")), item, "left")
    above_user = pairs.select(
        F.col("oui_id").alias("_at"), F.col("ancestor_id").alias("_node"), F.lit(True).alias("_up"))
    above_item = pairs.select(
        F.col("oui_id").alias("_node"), F.col("ancestor_id").alias("_at"), F.lit(True).alias("_down"))
    related = met.join(above_user, ["_at", "_node"], "left").join(above_item, ["_at", "_node"], "left")
    # The lowest exact place makes the choice repeatable when several match.
    return related.groupBy("user_id", item).agg(
        F.min(F.when(F.col("_at") == F.col("_node"), F.col("clearance"))).alias("_exact"),
        F.min(F.when(F.col("_up"), F.col("clearance"))).alias("_low"),
        F.max(F.when(F.col("_down"), F.col("clearance"))).alias("_high"),
        F.max(F.when(F.col("_node").isNull(), F.col("clearance"))).alias("_free"),
    ).select(
        "user_id", item,
        F.coalesce("_exact", "_low", "_high", "_free", F.lit(1)).alias("effective_clearance"),
    )


def content_gate(found: DataFrame, clearance: DataFrame, stored: str, text: str) -> DataFrame:
    """Results (user_id, ...) whose own `level` is within their user's clearance; 1 for users without one.

    The level is the stored one where it is valid, else the highest whose patterns the whole text has.
    """
    levelled = found.withColumn("level", dt.classify_sensitivity(F.col(stored), F.col(text)))
    return levelled.join(clearance.select("user_id", "max_clearance"), "user_id", "left").where(
        F.col("level") <= F.coalesce("max_clearance", F.lit(1))).drop("max_clearance")


def max_chunk_sensitivity(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    own = F.coalesce(F.nullif("chunk_sensitivity", F.lit(0)), F.nullif("sensitivity", F.lit(0)), F.lit(1))
    return chunks.groupBy(key).agg(F.greatest(F.lit(1), F.max(own)).alias("max_sensitivity"))


# ---- requests and grants -----------------------------------------------------------------

def latest_requests(requests: DataFrame) -> DataFrame:
    """Newest request per (user, document)."""
    order = [F.col("created_at").desc(), F.col("request_id").desc()]
    return top_k(requests, ["user_id", "doc_id"], order, 1).drop("rank")


def settle_expiry(requests: DataFrame, now: Column) -> DataFrame:
    """Requests with expired approvals turned to revoked."""
    expired = (F.col("status") == "approved") & (F.col("expires_at") <= now)
    return requests.withColumn(
        "status", F.when(expired, "revoked").otherwise(F.col("status"))
    ).withColumn("resolved_at", F.when(expired, now))


def active_grants(requests: DataFrame, now: Column) -> DataFrame:
    """user_id, doc_id with an approval that has not run out."""
    return requests.where(
        (F.col("status") == "approved") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    ).select("user_id", "doc_id").distinct()


def access_status(
    wanted: DataFrame, clearance: DataFrame, sensitivity: DataFrame, requests: DataFrame
) -> DataFrame:
    """Per (user_id, doc_id): restricted parts, newest request, end of its approval."""
    latest = latest_requests(requests).select("user_id", "doc_id", "status", "expires_at")
    rows = (
        wanted.join(clearance.select("user_id", "max_clearance"), "user_id", "left")
        .join(sensitivity, "doc_id", "left").join(latest, ["user_id", "doc_id"], "left")
    )
    return rows.select(
        "user_id", "doc_id",
        (F.coalesce("max_sensitivity", F.lit(1)) > F.coalesce("max_clearance", F.lit(1)))
        .alias("has_restricted_chunks"),
        F.col("status").alias("access_request_status"),
        F.when(F.col("status") == "approved", F.col("expires_at")).alias("approved_until"),
    )


def file_gate(
    wanted: DataFrame, profile: DataFrame, sensitivity: DataFrame, grants: DataFrame
) -> DataFrame:
    """May the user open the file: top members, low enough content, or a grant."""
    rows = (
        wanted.join(profile.select("user_id", "max_clearance", "is_corp_member"), "user_id", "left")
        .join(sensitivity, "doc_id", "left")
        .join(grants.withColumn("_grant", F.lit(True)), ["user_id", "doc_id"], "left")
    )
    low = F.coalesce("max_sensitivity", F.lit(1)) <= F.coalesce("max_clearance", F.lit(1))
    return rows.select(
        "user_id", "doc_id",
        (F.coalesce("is_corp_member", F.lit(False)) | low | F.col("_grant").isNotNull()).alias("file_open"),
    )


def upload_allowed(wanted: DataFrame, held: DataFrame, corp: DataFrame, pairs: DataFrame) -> DataFrame:
    """May the user put a document at the node: holds it or a node above it, or is at the top."""
    own = wanted.join(held.select("user_id", "oui_id"), ["user_id", "oui_id"], "left_semi")
    above = (
        wanted.join(pairs, "oui_id")
        .join(held.select("user_id", F.col("oui_id").alias("ancestor_id")), ["user_id", "ancestor_id"], "left_semi")
        .select("user_id", "oui_id")
    )
    top = wanted.join(corp, "user_id", "left_semi")
    yes = own.unionByName(above).unionByName(top.select("user_id", "oui_id")).distinct()
    return wanted.join(yes.withColumn("_yes", F.lit(True)), ["user_id", "oui_id"], "left").select(
        *wanted.columns, F.col("_yes").isNotNull().alias("allowed"))


def request_timeline(events: DataFrame) -> DataFrame:
    """Events with an `expire` row for each approval that has an end, in one order per (user, document).

    At the same instant an end comes before other events, for an approval has run out at its end; an
    approval that ends before it is given runs out right after it.
    """
    late = F.col("expires_at") > F.col("created_at")
    rows = events.select(
        "user_id", "doc_id", "event_id", "kind", "created_at", F.col("event_id").alias("_tie"), F.lit(0).alias("_sub"))
    ends = events.where((F.col("kind") == "approve") & F.col("expires_at").isNotNull()).select(
        "user_id", "doc_id", "event_id", F.lit("expire").alias("kind"),
        F.greatest("expires_at", "created_at").alias("created_at"),
        F.when(late, F.lit(-(1 << 63))).otherwise(F.col("event_id")).alias("_tie"), F.lit(1).alias("_sub"))
    return rows.unionByName(ends)


def apply_request_events(events: DataFrame) -> DataFrame:
    """Judge request events, and the ends of approvals, in time order per (user, document).

    `events`: user_id, doc_id, event_id, created_at, kind in request, approve, reject, revoke, and expires_at
    of an approval or null. Adds the state before the event, `valid` and the state after. An approval
    that runs out while it holds has a row of kind `expire` with its own event_id; it turns to revoked,
    so that a revoke after the end is invalid.

    After a request the state is pending, whatever it was, so requests cut a history into segments that
    are judged by running windows: the first decision of a segment holds, and of an approval the first end
    or revoke. No history is gathered into a row; a window reads it in order and can spill.
    """
    pair, order = ["user_id", "doc_id"], ["created_at", "_tie", "_sub", "event_id"]
    rows = request_timeline(events)
    whole = Window.partitionBy(*pair).orderBy(*order)
    cut = rows.withColumn("_segment", F.count_if(F.col("kind") == "request").over(
        whole.rowsBetween(Window.unboundedPreceding, 0)))
    # The same partitioning: rows move once.
    segment = Window.partitionBy(*pair).orderBy("_segment", *order)
    up_to = segment.rowsBetween(Window.unboundedPreceding, 0)
    before = segment.rowsBetween(Window.unboundedPreceding, -1)
    requested = F.col("_segment") > 0
    # Running values carry their segment's number, and count only in it.
    decided = F.when(F.col("kind").isin("approve", "reject") & requested, F.struct("_segment", "kind", "event_id"))
    first = cut.withColumn("_decision", decided).withColumn("_last", F.lag("_segment").over(segment))
    firsts = first.withColumn("_fresh", F.when(
        F.col("_decision").isNotNull() & (F.coalesce(
            F.last(F.col("_decision")["_segment"], ignorenulls=True).over(before), F.lit(-1)) < F.col("_segment")),
        F.col("_decision")))
    held = firsts.withColumn("_held", F.last("_fresh", ignorenulls=True).over(up_to))
    here = F.col("_held")["_segment"] == F.col("_segment")
    approved = F.coalesce(here & (F.col("_held")["kind"] == "approve"), F.lit(False))
    ends = approved & ((F.col("kind") == "revoke") | (
        (F.col("kind") == "expire") & (F.col("event_id") == F.col("_held")["event_id"])))
    ended = held.withColumn("_end", F.when(ends, F.col("_segment"))).withColumn(
        "_ended", F.last("_end", ignorenulls=True).over(before)).withColumn("_done", F.last("_end", ignorenulls=True).over(up_to))
    over = lambda c: F.coalesce(F.col(c) == F.col("_segment"), F.lit(False))
    after = (
        F.when(~requested, "none").when(~F.coalesce(here, F.lit(False)), "pending")
        .when(F.col("_held")["kind"] == "reject", "rejected").when(over("_done"), "revoked").otherwise("approved"))
    judged = ended.withColumn("state_after", after).withColumn(
        "state_before", F.coalesce(F.lag("state_after").over(segment), F.lit("none")))
    valid = F.col("state_before") != F.col("state_after")
    return judged.where((F.col("kind") != "expire") | valid).select(
        *pair, "event_id", "kind", "state_before", valid.alias("valid"), "state_after")


REVIEW_STEPS = [
    # action, state, by owner, by top member, next state, job effect
    ("submit", "uploaded", True, False, "review", "none"),
    ("submit", "uploaded", True, True, "approved", "queued"),
    ("approve", "review", None, True, "approved", "queued"),
    ("approve", "uploaded", None, True, "approved", "queued"),
    ("reject", "review", None, True, "draft", "cancelled"),
    ("reject", "uploaded", None, True, "draft", "cancelled"),
]


def review_decisions(actions: DataFrame, docs: DataFrame, corp: DataFrame) -> DataFrame:
    """Outcome of review actions (doc_id, user_id, action); others keep state and say why."""
    rows = actions.join(docs.select("doc_id", "status", "owner_user_id"), "doc_id").join(
        corp.withColumn("_top", F.lit(True)), "user_id", "left"
    ).withColumn("_top", F.coalesce("_top", F.lit(False)))
    is_owner = F.col("user_id") == F.col("owner_user_id")
    next_status, effect = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, state, by_owner, by_top, then, job in REVIEW_STEPS:
        match = (F.col("action") == action) & (F.col("status") == state)
        if by_owner is not None:
            match = match & is_owner
        match = match & (F.col("_top") == by_top)
        next_status = F.when(match, then).otherwise(next_status)
        effect = F.when(match, job).otherwise(effect)
    reason = (
        F.when((F.col("action") == "submit") & ~is_owner, "owner_required")
        .when((F.col("action") != "submit") & ~F.col("_top"), "corp_required")
        .otherwise("wrong_status")
    )
    return rows.select(
        "doc_id", "user_id", "action", "status",
        F.coalesce(next_status, F.col("status")).alias("next_status"),
        F.coalesce(effect, F.lit("none")).alias("job_effect"),
        F.when(next_status.isNotNull(), "ok").otherwise(reason).alias("reason"),
    )


def create_decision(role: Column, own_department: Column, department: Column) -> Column:
    """Reason code of the role rule for creating a document; `ok` allows it."""
    return (
        F.when(role.isin("director", "admin_auditor"), "ok")
        .when(department.isNull() & (role == "department_manager"), "ok")
        .when(department.isNull(), "only_managers_can_create_company_doc")
        .when(role.isin("department_manager", "employee") & (own_department == department), "ok")
        .when(role.isin("department_manager", "employee"), "department_scope_denied")
        .otherwise("role_or_scope_denied")
    )


def update_decision(
    is_owner: Column, can_edit: Column, status: Column, role: Column, clearance: Column, level: Column
) -> Column:
    """Reason code of the role rule for changing a document; `ok` allows it."""
    def rank(c: Column) -> Column:
        ranks = F.create_map(*[F.lit(x) for kv in fixed.ROLE_LEVEL_RANKS.items() for x in kv])
        return F.coalesce(ranks[F.coalesce(F.nullif(c, F.lit("")), F.lit("internal"))], F.lit(0))

    return (
        F.when(is_owner, "ok").when(~can_edit, "fga_denied")
        .when((status == "archived") & (role != "admin_auditor"), "archived_denied")
        .when(rank(clearance) < rank(level), "clearance_denied")
        .when(role.isin(fixed.EDIT_ROLES), "ok").otherwise("role_denied")
    )


def visible_jobs(jobs: DataFrame, viewers: DataFrame) -> DataFrame:
    """user_id, job_id: own jobs of the viewers; who sees all jobs needs no list."""
    return jobs.join(viewers.select(F.col("user_id").alias("created_by")), "created_by").select(
        F.col("created_by").alias("user_id"), "job_id")


def job_summary(jobs: DataFrame, viewers: DataFrame, corp: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, n_jobs, id_sum of the jobs a viewer sees: own ones, or all.

    Top members and elevated roles see every job; they get the totals of one aggregate, so that
    no job is paired with a viewer.
    """
    elevated = users.where(F.col("role").isin(fixed.ALL_JOB_ROLES)).select("user_id")
    every = viewers.join(corp.select("user_id").unionByName(elevated).distinct(), "user_id", "left_semi")
    totals = jobs.agg(F.count("job_id").alias("n_jobs"), F.sum("job_id").alias("id_sum"))
    own = visible_jobs(jobs, viewers.join(every, "user_id", "left_anti")).groupBy("user_id").agg(
        F.count("job_id").alias("n_jobs"), F.sum("job_id").alias("id_sum"))
    whole = every.select(
        "user_id", totals.select("n_jobs").scalar().alias("n_jobs"), totals.select("id_sum").scalar().alias("id_sum"))
    return own.unionByName(whole.where("n_jobs > 0"))
