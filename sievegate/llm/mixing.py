"""Mixing sources to target weights as a curriculum that changes over training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.llm.common import apart, given_back, quoted, renamed, running_start, without

#: Base weights by rank of the source, repeating, and the slope of each weight over training:
#: a source of slope g has the weight w * (1 + g * (2t - 1)) at time t between 0 and 1.
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.6, 0.0, 0.6)
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(totals: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Per source: source_size, target and slope, from (source, source_size).

    The words to mix are `share` times all words. They are dealt by weight; no source gets more
    than `limit` times its size, and what is over goes to the others by weight. With the sources
    in order of limit by weight, the level each free source gets per unit of weight is
    (words left) / (weight left) at the first source that does not reach its limit, which is the
    largest of these quotients. One row per source, so the windows are over a small table.
    """
    ranked = totals.withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    pick = lambda values: F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod("_rank", F.lit(len(values))) + 1).cast("int"))
    weighed = ranked.withColumns({"_w": pick(WEIGHTS), "slope": pick(SLOPES)}).withColumn(
        "_cap", F.lit(limit) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = weighed.withColumns({
        "_left": F.lit(share) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_weight": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    }).withColumn("_level", F.max(F.col("_left") / F.col("_weight")).over(everything))
    return levels.select(
        "source", "source_size", "slope",
        F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def invert_demand(part: Column, slope: Column) -> Column:
    """Time at which a source has used `part` of its demand.

    The schedule integrates to t + slope * (t * t - t); this is its inverse, in the form that
    holds for slope 0 and loses no digits.
    """
    linear = F.lit(1.0) - slope
    return 2.0 * part / (linear + F.sqrt(linear * linear + 4.0 * slope * part))


def mix_documents(
    docs: DataFrame, share: float = 1.5, limit: float = 2.0, digits: int = 3,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add size, source_size, target, taken and positions to every document.

    Documents of a source stand in the order of a digest of doc_id and size, cut into blocks by its
    first `digits` hexadecimal digits (4,096 blocks a source by default); the source's words
    are read in that order again and again until its target is reached. A reading of a document
    counts if its middle lies before the target, so a source is off by half a document at most.
    `positions` has the training time, from 0 to 1, of each reading; `taken` is size times the
    readings. Null texts and texts without words have size 0 and are not taken; null sources are a
    source of their own, last in order; repeated rows count each; an empty table stays empty.
    Columns in `drop` are left out; columns of the added names are replaced.
    """
    added = ["size", "source_size", "target", "taken", "positions"]
    text = F.coalesce(F.col("text"), F.lit(""))
    base, names = renamed(without(docs, added), keep=("doc_id", "source", "text"))
    sized = without(base.withColumn("size", F.regexp_count(text, F.lit(WORDS)).cast("long")), [names[c] for c in drop if c in names])
    sized = sized.withColumn("_key", F.md5(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))))

    def with_target(starts: DataFrame) -> DataFrame:
        totals = starts.groupBy("_group").agg(F.sum("_sum").alias("source_size"))
        targets = source_targets(totals.select("_group.source", "source_size"), share, limit)
        return starts.join(targets.withColumn("_group", F.struct("source")).drop("source"), "_group")

    placed = running_start(
        sized, ["source"], ["_key"], F.col("size"), 16**digits, "_start", with_target,
        F.conv(F.substring("_key", 1, digits), 16, 10))
    middle = F.col("_start") + F.col("size") / 2
    whole = F.nullif("source_size", F.lit(0))
    copies = F.when(
        F.col("size") > 0, F.greatest(F.lit(0), F.floor((F.col("target") - middle) / whole) + 1),
    ).otherwise(F.lit(0)).cast("int")
    part = lambda k: (k * F.col("source_size") + middle) / F.nullif("target", F.lit(0.0))
    mixed = placed.withColumn("_copies", copies).withColumns({
        "taken": F.col("size") * F.col("_copies"),
        "positions": F.when(
            F.col("_copies") > 0,
            F.transform(F.sequence(F.lit(0), F.col("_copies") - 1),
                        lambda k: invert_demand(part(k), F.col("slope"))),
        ).otherwise(F.array().cast("array<double>")),
    })
    return given_back(mixed, names, added, drop)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Mixed documents, range-sorted by the time of their first reading; those not taken come last."""
    first = F.try_element_at("positions", F.lit(1))
    return mixed.orderBy(first.asc_nulls_last(), "doc_id")


def rank_readings(mixed: DataFrame, columns: list[str], blocks: int = 4096) -> DataFrame:
    """One row per reading: `columns`, reading (from 1), position and rank (from 1) in ordered_mix's order.

    Positions lie between 0 and 1 and are dense everywhere there, so equal intervals of them are the
    blocks that are sorted, each by a task of its own. Readings of the same position and doc_id, which
    nothing tells apart, have consecutive ranks.
    """
    readings = mixed.select(*columns, F.posexplode("positions").alias("_at", "position")).withColumn(
        "reading", F.col("_at") + 1).drop("_at")
    ranked = running_start(
        readings, [F.lit(0).alias("_all")], ["position", "doc_id"], F.lit(1), blocks, "_before",
        block=F.floor(F.col("position") * blocks))
    return ranked.select(*columns, "reading", "position", (F.col("_before") + 1).alias("rank"))


def ordered_mix(docs: DataFrame, columns: list[str] | None = None, **settings) -> DataFrame:
    """One row per reading, sorted by position over the whole output.

    With `columns`, these columns as given and nothing else: documents that the mix does not take
    are gone, and those it takes twice are there twice.
    """
    inner, back = apart(docs)
    named = inner.withColumns({c: F.col(quoted(inner.columns[docs.columns.index(c)])) for c in ("doc_id", "source")})
    mixed = mix_documents(named if columns else docs, **settings)
    rows = mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "doc_id")
    return back(rows).select(*[F.col(quoted(c)) for c in columns]) if columns else rows
