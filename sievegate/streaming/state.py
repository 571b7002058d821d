"""Stateful streams: job life cycle, grant expiry, outbox, refreshed dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOB_MOVES = {
    ("queue", "new"): "queued", ("queue", "pending_approval"): "queued",
    ("start", "queued"): "running", ("succeed", "running"): "succeeded",
    ("fail", "running"): "failed", ("cancel", "queued"): "failed",
    ("cancel", "running"): "failed", ("retry", "failed"): "queued",
}


def track_jobs(events: DataFrame) -> DataFrame:
    """Running status and retries per job; emits the state after every batch.

    `events`: job_id, event_id, event. State is two small values per job.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, retries = state.get if state.exists else ("new", 0)
        rows = [row for pdf in batches for row in zip(pdf["event_id"], pdf["event"])]
        for _, event in sorted(rows):
            after = JOB_MOVES.get((event, status), status)
            retries += event == "retry" and status == "failed"
            status = after
        state.update((status, int(retries)))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "retries": [int(retries)]})

    return events.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, status string, retries int", "status string, retries int",
        "update", GroupStateTimeout.NoTimeout)


GRANT_BUCKETS = 512  # part of the state: a checkpoint goes on with the number it began with
ENDLESS = 2**63 - 1


def expire_grants(requests: DataFrame, late: str = "0 seconds", buckets: int = GRANT_BUCKETS) -> DataFrame:
    """Revoke approvals when event time passes their end.

    `requests`: request_id, status, created_at (event time), expires_at or null. The last row of a
    request decides, and the watermark drives the clock. Requests share groups by a hash of their id, so
    a batch costs a call of Python for each group and not for each request. The state of a group is the ids and
    ends of its open grants, its timer the first of these ends.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else (b"", b"")
        ids, ends = (np.frombuffer(part, "int64") for part in known)
        watermark = state.getCurrentWatermarkMs()
        over = ends < watermark
        # All requests without an id are one, in a group of its own.
        named = lambda found: found if key[0] >= 0 else [None] * len(found)
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("_at", kind="stable").drop_duplicates("request_id", keep="last")
            yield pd.DataFrame({"request_id": named(rows["request_id"].to_numpy()), "status": rows["status"].to_numpy()})
            # A later row replaces what was known: its end alone decides, or nothing does.
            other, ending = ~np.isin(ids, rows["request_id"]), rows[rows["_end"] != ENDLESS]
            over = np.concatenate([over[other], ending["_end"] <= watermark])
            ids = np.concatenate([ids[other], ending["request_id"]])
            ends = np.concatenate([ends[other], ending["_end"]])
        if over.any():
            yield pd.DataFrame({"request_id": named(ids[over]), "status": "revoked"})
        if over.all():
            state.remove()
        else:
            state.update((ids[~over].tobytes(), ends[~over].tobytes()))
            state.setTimeoutTimestamp(int(ends[~over].min()))

    key, end = F.col("request_id").cast("long"), F.unix_millis(F.col("expires_at").cast("timestamp"))
    rows = requests.withWatermark("created_at", late).select(
        F.when(key.isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int").alias("_bucket"),
        F.coalesce(key, F.lit(0)).alias("request_id"), "status", "created_at",
        F.coalesce(F.unix_micros("created_at"), F.lit(ENDLESS)).alias("_at"),
        F.coalesce(F.when(F.col("status") == "approved", end), F.lit(ENDLESS)).alias("_end"))
    return rows.groupBy("_bucket").applyInPandasWithState(
        step, "request_id long, status string", "ids binary, ends binary", "append",
        GroupStateTimeout.EventTimeTimeout)


def first_requests(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drop repeats of an idempotency key inside the watermark."""
    return requests.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["idempotency_key"])


def pending_outbox(spark: SparkSession, path: str, schema) -> DataFrame:
    """Outbox events still waiting to be published."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("status") == "queued")


def with_fresh_dimension(read_dimension: Callable[[], DataFrame], on: list[str], write) -> Callable[[DataFrame, int], None]:
    """Batch writer that joins each micro-batch with the dimension as it is now."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch.join(read_dimension(), on, "left"), batch_id)

    return run


def valid_spans(snapshots: DataFrame, on: list[str], since: str = "valid_from") -> DataFrame:
    """Versions of a dimension with the time up to which each holds; null for the newest of its key."""
    following = F.lead(since).over(Window.partitionBy(*on).orderBy(since))
    return snapshots.withColumn("valid_to", following)


def with_valid_dimension(
    read_snapshots: Callable[[], DataFrame], on: list[str], event_time: str, write, since: str = "valid_from",
) -> Callable[[DataFrame, int], None]:
    """Batch writer that joins each row with the version of the dimension that held at its event time.

    Snapshots are read anew for each batch, so new versions are seen; a late row still meets the
    version of its own time. Rows before the first version of their key keep nulls.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spans = valid_spans(read_snapshots(), on, since)
        same = [batch[c] == spans[c] for c in on]
        within = (batch[event_time] >= spans[since]) & (spans["valid_to"].isNull() | (batch[event_time] < spans["valid_to"]))
        joined = batch.join(spans, [*same, within], "left").drop(*[spans[c] for c in on])
        write(joined.drop("valid_to"), batch_id)

    return run
