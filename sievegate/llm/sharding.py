"""Sharding by jump consistent hashing: no ring table, and growth moves only what it must."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import given_back, renamed, running_start, without


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; going from n to n + 1 shards moves keys only to shard n."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    rows = np.arange(len(state))
    jump = np.zeros(len(state), dtype=np.int64)
    while len(rows):
        shard[rows] = jump
        state = state * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((jump + 1) * (float(1 << 31) / draw)).astype(np.int64)
        on = jump < shards
        rows, state, jump = rows[on], state[on], jump[on]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Shard number of a key of any type, null included: its 64-bit hash, then jump hashing."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def place(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy().view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def shard_documents(
    docs: DataFrame, shards: int, key: str = "doc_id", grown: int | None = None, blocks: int = 1024,
    place: str | None = None,
) -> DataFrame:
    """Add law, shard, grown_shard (with `grown` shards, one more by default) and slot.

    The shard depends on the key and the shard count alone: equal keys, repeated rows and null
    keys (one key of their own) stay together. Slots count from 0 without gaps in each shard, in
    an order of hashed blocks, then key, text checksum and size; with `place`, in the order of this
    column of different longs, which is left out of the result. Null texts count as empty. An
    empty table gives an empty result. Columns named like the added ones are replaced.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    base, names = renamed(without(docs, added), keep=(key, "text", place))
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    rows = base.withColumns({
        "size": (F.octet_length(text) + 8).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")).cast("long"),
    })
    placed = rows.withColumns({
        "law": F.lit("key"),
        "shard": jump_shard(F.col(key), shards),
        "grown_shard": jump_shard(F.col(key), grown or shards + 1),
    })
    if place is None:
        slotted = running_start(placed, ["shard"], [key, "text_crc32", "size"], F.lit(1), blocks, "slot")
    else:
        slotted = running_start(placed, ["shard"], [place], F.lit(1), blocks, "slot", block=F.shiftright(place, 13))
    return given_back(slotted, names, added, (place,) if place else ())


def with_place(docs: DataFrame, name: str) -> DataFrame:
    """Add the place of each row in the order in which the rows were written.

    Of files this is the number of the part file, then the row in it, however the scan deals the files
    to tasks: a range sort writes its partitions as part files in order. Rows that come from no file
    have the order of their partitions.
    """
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        return docs.select("*", (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias(name))
    except AnalysisException:
        return docs.withColumn(name, F.monotonically_increasing_id())
