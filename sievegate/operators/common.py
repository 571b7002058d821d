"""Shared building blocks of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW_KEYS = 200_000  # keys sent to every task


def unnest(df: DataFrame, keep: list, array: Column | str, value: str, position: str = "_pos") -> DataFrame:
    """One row per array element, with its 0-based position.

    The kept columns are computed before the explode, so that its rows do not each
    carry the whole array. The outer form plus a filter on the position: a plain
    explode makes the optimizer infer a filter on the array, push it to the scan
    and evaluate the whole expression that builds the array a second time.
    """
    array = F.col(array) if isinstance(array, str) else array
    ready = df.select(*keep, array.alias("_array"))
    kept = [c for c in ready.columns if c != "_array"]
    rows = ready.select(*kept, F.posexplode_outer("_array").alias(position, value))
    return rows.where(F.col(position).isNotNull())


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key with a 0-based rank.

    Spark cuts every partition to k rows per key before the shuffle, so a key
    that holds most rows sends only k of them per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(window))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.col(rank) - 1)
    )


def small_rows(df: DataFrame, limit: int) -> list | None:
    """The rows if there are at most `limit` of them, else None.

    Reads one row more than the limit at most; the check for every broadcast.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def rows_of(large: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of `large` whose `key` is among the rows of `wanted` (kept, as it is read again to count its keys).

    Keys that are counted to be few go to every task, so nothing of the other rows is shuffled or sorted.
    """
    keys = wanted.select(key).distinct()
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return large.join(F.broadcast(keys) if few else keys, key, "left_semi")


def spread(df: DataFrame, id_col: str, buckets: int) -> DataFrame:
    """Add a salt in [0, buckets) that depends on the row only."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"))


def salted_join(
    large: DataFrame, small: DataFrame, on: list[str], id_col: str, buckets: int = 16,
) -> DataFrame:
    """Inner join whose keys may each hold a large share of `large`.

    Rows of one key go to `buckets` tasks; the other side is repeated per bucket.
    """
    salted = spread(large, id_col, buckets)
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(repeated, [*on, "_salt"]).drop("_salt")
