"""Shared helpers: words of a text, columns computed over Arrow batches, block-wise running sums."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Lower-cased words over UTF-8: ASCII digits and letters, and every character outside ASCII.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased (bytes.lower touches nothing else); null has none."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hash of each word."""
    found = lower_words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))


def as_bytes(name: str = "text") -> Column:
    return F.col(name).cast("string").cast("binary")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, names) -> DataFrame:
    """Drop columns by name in any case: an operator's columns replace columns of the same name."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in gone])


def map_batches(
    df: DataFrame, inputs: list[Column], added: str, start: Callable[[], Callable], drop=(),
) -> DataFrame:
    """Add columns that Python computes from `inputs`, one Arrow batch at a time.

    `start` runs once per task and gives a function from the input arrays to one sequence per
    added column. Nothing is kept between batches but what `start` builds. Columns of `df` that
    are in `drop`, or have the name of an added column, are left out.
    """
    new = StructType.fromDDL(added)
    gone = {n.lower() for n in drop} | {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = StructType([*kept, *new.fields])
    types = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in schema]
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if batch.num_rows:
                results = work(*batch.columns[n_kept:])
                arrays = [pa.array(r, type=t) for r, t in zip(results, types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *arrays], names=names)

    columns = [c.alias(f"_in{i}") for i, c in enumerate(inputs)]
    return df.select(*[F.col(quoted(f.name)) for f in kept], *columns).mapInArrow(run, schema)


def running_start(
    df: DataFrame, group: list[str | Column], order: list[str], amount: Column, blocks: int, name: str,
    extra: Callable[[DataFrame], DataFrame] | None = None, block: Column | None = None,
) -> DataFrame:
    """Sum of `amount` over the rows before each row of its group, in an order set by a hash.

    A group may hold any share of the rows: it is cut into `blocks` blocks by a hash of `order`,
    the blocks' sums are added up (one row per block, summed before the shuffle), and only rows of
    one block are sorted together. Rows that agree in all of `order` must have the same amount.
    `block` replaces the hash where the blocks' order is to be that of `order`.
    `extra` may join more columns to the small table of blocks, by the struct `_group`.
    """
    hashed = F.pmod(F.xxhash64(*order), F.lit(blocks)) if block is None else block
    # The group as a struct is never null, so that the window and the join share one exchange.
    keyed = df.withColumns({
        "_group": F.struct(*group), "_block": hashed.cast("long"), "_amount": amount.cast("long")})
    sums = keyed.groupBy("_group", "_block").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_block_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    starts = (extra(starts) if extra else starts).drop("_sum")
    within = Window.partitionBy("_group", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("_within", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    joined = rows.join(starts, ["_group", "_block"])
    return joined.withColumn(name, F.col("_block_start") + F.col("_within")).drop(
        "_group", "_block", "_amount", "_block_start", "_within")


def apart(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Columns but the text under names that clash with none, and the way back to their own."""
    names = {c: c if c == "text" else f"_c{i}" for i, c in enumerate(df.columns)}
    renamed = df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()])
    return renamed, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def renamed(df: DataFrame, keep=("text",)) -> tuple[DataFrame, dict[str, str]]:
    """Columns but those in `keep` under names that clash with no working column, and the names they got."""
    names = {c: c if c in keep else f"_c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), names


def given_back(df: DataFrame, names: dict[str, str], added: list[str], drop=()) -> DataFrame:
    """Columns of `renamed` under their own names, without those in `drop`, then the added ones in place of their like."""
    gone = {n.lower() for n in (*drop, *added)}
    kept = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in gone]
    return df.select(*kept, *added)


def unused(df: DataFrame, name: str) -> str:
    """`name`, longer by underscores until no column is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashed_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """At most `size` rows: those whose hashed key comes first.

    Rows that cannot be among them are left out before any are brought together, so that what one
    task gathers does not grow with the number of tasks.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    if total > 4 * size:
        df = df.where(place < int((1 << 31) * size / total))
    return df.orderBy(place, key).limit(size)
