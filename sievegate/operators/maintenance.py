"""Keeping tables current: upserts, deletes, patches, registries, jobs, settings.

Each function takes the current table and the change and returns the next table;
the sinks write it partition by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import text as tx
from sievegate.operators.common import top_k
from sievegate.session import shared_dir


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of both tables, the last change of a key in place of the current row.

    Only changes are ranked; current rows meet the changed keys in an anti join, so
    no key with many versions is gathered with the whole table.
    """
    last = top_k(changes, [key], order, 1).drop("rank").select(*current.columns)
    return current.join(last.select(key), key, "left_anti").unionByName(last)


def delete_keys(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti")


def delete_prefix(current: DataFrame, key: str, prefix: str) -> DataFrame:
    return current.where(~F.col(key).startswith(prefix))


def rows_of_keys(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_semi")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], keys: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove documents from all tables that hang on them.

    `tables`: name -> (table, key column); `keys`: key column -> keys to remove.
    """
    return {name: delete_keys(df, keys[key], key) for name, (df, key) in tables.items()}


def cascade_graph(
    tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, gone: DataFrame,
) -> dict[str, DataFrame]:
    """Rows to remove from every table when the rows of `root` that match `gone` go.

    `links`: (child, its column, parent, its column) with parents first. A child row goes if any parent row
    it points to goes. Only keys meet keys; a table that nothing reaches is not in the result.
    """
    shared_dir(gone.sparkSession)
    lost = {root: tables[root].join(gone.distinct(), gone.columns, "left_semi").checkpoint()}
    for child in dict.fromkeys(c for c, *_ in links):
        hit = None
        for _, column, parent, key in (x for x in links if x[0] == child and x[2] in lost):
            keys = lost[parent].select(F.col(key).alias(column)).distinct()
            rows = tables[child].join(keys, column, "left_semi")
            hit = rows if hit is None else hit.unionByName(rows).distinct()
        if hit is not None:
            lost[child] = hit.checkpoint()
    return lost


def update_metadata(current: DataFrame, ids: DataFrame, key: str, values: dict[str, str | None]) -> DataFrame:
    """Set metadata entries on the rows named in `ids`; a null becomes an empty text."""
    new = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, "" if v is None else v)])
    kept = F.map_filter("metadata", lambda k, _: ~k.isin(list(values)))
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return current.join(hit, key, "left").withColumn(
        "metadata", F.when(F.col("_hit"), F.map_concat(kept, new)).otherwise(F.col("metadata"))
    ).drop("_hit")


def flatten_metadata(scalars: dict[str, Column], nested: dict[str, Column]) -> Column:
    """Metadata map without nulls; nested values as JSON text."""
    pairs = [x for k, v in scalars.items() for x in (F.lit(k), v.cast("string"))]
    pairs += [x for k, v in nested.items() for x in (F.lit(k), F.to_json(v))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def patch_rows(current: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Supplied (non-null) fields of the patch replace the current ones."""
    names = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias("_new_" + c) for c in names])
    rows = current.join(renamed, key, "left")
    return rows.select(*[
        F.coalesce("_new_" + c, c).alias(c) if c in names else F.col(c) for c in current.columns])


def registry_rows(objects: DataFrame, bucket: str) -> DataFrame:
    """Registry entry per object: `objects` has object_key, content (binary)."""
    return objects.select(
        F.lit(bucket).alias("bucket"), "object_key", F.octet_length("content").alias("size_bytes"),
        F.sha2("content", 256).alias("checksum"))


def audit_rows(actions: DataFrame, detail: list[str]) -> DataFrame:
    """Audit entries with a stable id and the detail columns as JSON."""
    keys = ["user_id", "action", "resource_id", "created_at"]
    return actions.select(
        F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256).alias("audit_id"),
        *keys, "decision", F.to_json(F.struct(*detail)).alias("output_json"))


def outbox_rows(actions: DataFrame, event_type: str, payload: list[str]) -> DataFrame:
    return actions.select(
        F.sha2(F.concat_ws("|", F.lit(event_type), F.col("resource_id").cast("string"),
                           F.col("created_at").cast("string")), 256).alias("event_id"),
        F.lit(event_type).alias("event_type"), F.to_json(F.struct(*payload)).alias("payload"),
        F.lit("queued").alias("status"), "resource_id", "created_at")


def merged_settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """All settings: stored values win, unknown keys are refused, JSON text decoded."""
    known = stored.join(defaults.select("setting"), "setting", "left_semi").withColumnRenamed("value", "_stored")
    rows = defaults.join(known, "setting", "left").withColumn("value", F.coalesce("_stored", "value"))
    decoded = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v"), F.col("value"))
    return rows.select("setting", decoded.alias("value"))


# ---- document and job state ---------------------------------------------------------

def document_types(docs: DataFrame, current_versions: DataFrame) -> DataFrame:
    """doc_id, document_type: the file extension in place of `general` where there is one."""
    named = docs.join(current_versions.select("doc_id", "file_name"), "doc_id", "left")
    has_dot = F.col("file_name").contains(".")
    return named.select("doc_id", F.when(
        (F.col("document_type") == "general") & has_dot, tx.file_extension("file_name")
    ).otherwise(F.col("document_type")).alias("document_type"))


def current_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("doc_id").agg(
        F.max("version_no").alias("version_no"), F.max_by("file_name", "version_no").alias("file_name"),
        F.count("*").alias("version_count"))


def version_numbers(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """doc_id, max_version_no, version_count; 0 where there is none."""
    return docs.select("doc_id").join(current_versions(versions), "doc_id", "left").select(
        "doc_id", F.coalesce("version_no", F.lit(0)).alias("max_version_no"),
        F.coalesce("version_count", F.lit(0)).alias("version_count"))


def latest_pending(jobs: DataFrame) -> DataFrame:
    """Newest job awaiting approval per document."""
    order = [F.col("created_at").desc(), F.col("job_id").desc()]
    return top_k(jobs.where("status = 'pending_approval'"), ["doc_id"], order, 1).drop("rank")


def idempotent_jobs(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """New ingest jobs from requests (version_id, force_new, request_id, created_at).

    A normal request has the key of its version and only makes a job when none has
    that key yet; a forced one always gets a key of its own.
    """
    keyed = requests.withColumn("idempotency_key", F.when(
        F.col("force_new"), F.concat(F.lit("ingest:"), F.col("version_id"), F.lit(":"), F.col("request_id"))
    ).otherwise(F.concat(F.lit("ingest:"), F.col("version_id"))))
    fresh = keyed.join(existing.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    order = [F.col("created_at").asc(), F.col("request_id").asc()]
    return top_k(fresh, ["idempotency_key"], order, 1).drop("rank")


JOB_EVENTS = ["queue", "start", "succeed", "fail", "retry", "cancel"]


def job_step(state: Column, event: Column) -> Column:
    """Next (status, retries) of a job; events that do not fit change nothing."""
    status, retries = state["status"], state["retries"]
    after = (
        F.when((event == "queue") & status.isin("new", "pending_approval"), "queued")
        .when((event == "start") & (status == "queued"), "running")
        .when((event == "succeed") & (status == "running"), "succeeded")
        .when((event == "fail") & (status == "running"), "failed")
        .when((event == "cancel") & status.isin("queued", "running"), "failed")
        .when((event == "retry") & (status == "failed"), "queued").otherwise(status)
    )
    more = F.when((event == "retry") & (status == "failed"), retries + 1).otherwise(retries)
    return F.struct(after.alias("status"), more.alias("retries"))


JOB_STATES = ["new", "pending_approval", "queued", "running", "succeeded", "failed"]


def through(segments: Column, start: Column) -> Column:
    """(status, retries) after an ordered array of segments, entered in status `start`."""
    def step(acc: Column, segment: Column) -> Column:
        end = F.element_at(segment["ends"], F.array_position(F.array(*map(F.lit, JOB_STATES)), acc["status"]).cast("int"))
        return F.struct(end["status"].alias("status"), (acc["retries"] + end["retries"]).alias("retries"))

    return F.aggregate(segments, F.struct(start.alias("status"), F.lit(0).alias("retries")), step)


def in_runs(rows: DataFrame, order: list[str], body: Column, longest: int) -> DataFrame:
    """(job_id, first, rows of `body` in order) of runs of at most `longest` consecutive rows of a job.

    Rows are sorted in ranges of (job, order), so that a job of any share of the rows lies over many
    ranges; a run is a job's rows in one block of a range.
    """
    keys = ["job_id", *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_run", F.expr(f"monotonically_increasing_id() div {longest}"))
    runs = placed.groupBy("job_id", "_run").agg(
        F.array_sort(F.collect_list(F.struct(*order, body.alias("_body")))).alias("_rows"))
    return runs.select("job_id", F.get("_rows", F.lit(0))[order[0]].alias("first"),
                       F.transform("_rows", lambda r: r["_body"]).alias("_rows"), F.size("_rows").alias("_n"))


def fold_jobs(events: DataFrame, longest: int = 1000) -> DataFrame:
    """Status and retries per job from its events (job_id, event_id, created_at, event).

    A run of at most `longest` events of a job becomes one segment: the end status and the retries for
    each status it may be entered in. Segments are folded the same way until every job has few; no
    history is ever in one row. Events with the same time and id go by name; unknown ones, and those
    that do not fit, change nothing.
    """
    shared_dir(events.sparkSession)
    timed = events.select("job_id", F.struct("created_at", "event_id", "event").alias("first"), "event")

    def ends(fold) -> Column:
        return F.array(*[fold(F.lit(s)) for s in JOB_STATES]).alias("ends")

    def by_events(start: Column) -> Column:
        return F.aggregate("_rows", F.struct(start.alias("status"), F.lit(0).alias("retries")), job_step)

    segments = in_runs(timed, ["first"], F.col("event"), longest).select(
        "job_id", "first", ends(by_events), F.col("_n").cast("long").alias("n_events")).checkpoint()
    while not segments.groupBy("job_id").count().where(F.col("count") > longest).isEmpty():
        body = F.struct("ends", "n_events")
        segments = in_runs(segments, ["first"], body, longest).select(
            "job_id", "first", ends(lambda start: through(F.col("_rows"), start)),
            F.aggregate("_rows", F.lit(0).cast("long"), lambda n, r: n + r["n_events"]).alias("n_events")).checkpoint()
    whole = segments.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "ends"))).alias("_rows"), F.sum("n_events").alias("n_events"))
    return whole.select("job_id", through(F.col("_rows"), F.lit("new")).alias("s"), "n_events").select(
        "job_id", "s.status", "s.retries", "n_events")


def job_steps(steps: DataFrame) -> DataFrame:
    """Per job: ordered step names, total and longest duration in milliseconds."""
    ms = steps.withColumn("_ms", F.col("ended_ms") - F.col("started_ms"))
    return ms.groupBy("job_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("started_ms", "step_name"))),
                                 lambda s: s["step_name"]), ">").alias("steps"),
        F.sum("_ms").alias("total_ms"), F.max("_ms").alias("longest_ms"))


def ordered_places(rows: DataFrame, scope: list[Column], order: list[Column]) -> DataFrame:
    """Rows with their 0-based `place` in the order of their scope, whatever share of them a scope has.

    All rows are sorted in ranges of (scope, order); a row's place is its number in all ranges less that
    of its scope's first row. Only the ranges' and scopes' counts are added up apart. `order` has to end
    with a key, else ties fall either way.
    """
    shared_dir(rows.sparkSession)
    scoped = rows.withColumn("_scope", F.struct(*scope, F.lit(0).alias("_")))
    placed = scoped.orderBy("_scope", *order).withColumn("_id", F.monotonically_increasing_id()).withColumns({
        "_range": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}).checkpoint()
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(
            Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.join(F.broadcast(ranges.select("_range", "_before")), "_range").withColumn(
        "_place", F.col("_before") + F.col("_row"))
    firsts = numbered.groupBy("_scope").agg(F.min("_place").alias("_first"))
    return numbered.join(firsts, "_scope").withColumn("place", F.col("_place") - F.col("_first")).drop(
        "_scope", "_id", "_range", "_row", "_before", "_place", "_first")


def backfilled_types(results: DataFrame, types: DataFrame) -> DataFrame:
    """Results whose `document_type` is still `general` take the registry's type of their document.

    `types`: document_id, document_type. Only documents that such results name are joined.
    """
    stale = results.where("document_type = 'general'").select("document_id").distinct()
    known = types.join(stale, "document_id", "left_semi").where("document_type <> ''").select(
        "document_id", F.col("document_type").alias("_type"))
    return results.join(known, "document_id", "left").withColumn("document_type", F.when(
        F.col("document_type") == "general", F.coalesce("_type", "document_type")).otherwise(F.col("document_type"))
    ).drop("_type")


def jobs_listing(jobs: DataFrame, docs: DataFrame, versions: DataFrame, limit: int = fixed.LIST_LIMIT) -> DataFrame:
    """Newest jobs with document title and version number; cut before the joins."""
    newest = jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)
    return newest.join(docs.select("doc_id", "title"), "doc_id", "left").join(
        versions.select("version_id", "version_no"), "version_id", "left")
