"""Incremental mail sync: new messages are indexed once; a lost index is filled again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.sources.mail import unsynced
from sievegate.sources.sinks import replace_partitions
from sievegate.streaming.ingest import bucketed, stored, touched

KEYS = ["user_id", "message_id"]


def sync_once(index_path: str, ledger_path: str, counts_path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for listings of mailboxes (user_id, message_id, subject, text), whatever they repeat.

    A message of a user is synced if the ledger lacks it, else skipped. If the index has no row at all
    while the ledger has, the ledger's history is not counted: everything listed is synced again.
    Messages without text are neither. Rows of a batch lie in partitions of its id, so that it can run
    again; of the ledger only the buckets of the batch's keys are read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, mine = batch.sparkSession, F.lit(batch_id).cast("long").alias("batch_id")
        listed = bucketed(batch.where(F.coalesce("text", F.lit("")) != "").dropDuplicates(KEYS).withColumn(
            "_key", F.concat_ws(":", *KEYS)), "_key").drop("_key")
        other = F.col("batch_id") != batch_id
        empty = stored(spark, index_path, "message_id long, batch_id long").where(other).isEmpty()
        ledger = touched(stored(spark, ledger_path, "user_id long, message_id long, bucket int, batch_id long"), listed)
        known = ledger.where(other & ~F.lit(empty)).select(*KEYS)
        fresh = unsynced(listed, known, KEYS).withColumn(
            "chunk_id", F.concat_ws("_", F.lit("mail"), "user_id", "message_id"))
        replace_partitions(fresh.select("chunk_id", *KEYS, "subject", "text", mine), index_path, ["batch_id"])
        replace_partitions(fresh.select(*KEYS, "bucket", mine), ledger_path, ["bucket", "batch_id"])
        synced = stored(spark, index_path, "").where(~other).groupBy("user_id").agg(F.count(F.lit(1)).alias("synced"))
        counts = listed.groupBy("user_id").agg(F.count(F.lit(1)).alias("listed")).join(synced, "user_id", "left").select(
            "user_id", F.coalesce("synced", F.lit(0)).alias("synced"),
            (F.col("listed") - F.coalesce("synced", F.lit(0))).alias("skipped"), mine)
        replace_partitions(counts, counts_path, ["batch_id"])

    return write
