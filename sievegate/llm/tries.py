"""Prefix trie of conversations: identical ones collapse into weighted sequences, prefixes are aggregated."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.session import shared_dir

#: Rows of one conversation that a window takes together, as a power of two of turn numbers or depths.
BLOCK_BITS = 8
#: Ids of one sequence's ends that are joined to one piece of text.
PIECE_BITS = 12
KEY = ["depth", "x1", "x2"]


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base: crc32 of the decimal id, modulo four."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 20


def running(rows: DataFrame, group: str, block: Column, order: list, amounts: dict[str, Column], more: Callable | None = None):
    """Running aggregates over a group that may hold any share of the rows, whose blocks follow its order.

    `amounts` has aggregate columns by name. Rows of one block are sorted together; blocks are added up
    from one row each. Gives, by name, the aggregate up to and with the row within its block, and
    under `name` + "_before" that of the blocks before (null in the first). `more` may join columns to the
    table of blocks. Rows move once, by group and block.
    """
    keyed = rows.withColumn("_block", block)
    blocks = keyed.groupBy(group, "_block").agg(*[a.alias(n) for n, a in amounts.items()])
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    combine = {n: F.bit_xor(n) if n.startswith("x") else F.sum(n) for n in amounts}
    starts = blocks.select(group, "_block", *[combine[n].over(before).alias(f"{n}_before") for n in amounts])
    starts = (more(starts) if more else starts).withColumnsRenamed({group: "_g", "_block": "_b"})
    within = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = keyed.withColumns({n: a.over(within) for n, a in amounts.items()})
    same = (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b"))
    return here.join(starts, same).drop("_block", "_g", "_b")


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns as conv_id, place (from 0), words and two hashes of role and text; texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(text.cast("binary")).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    block = F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-1 << 62))  # below all others
    placed = running(turns, "conv_id", block, order, {"place": F.count(F.lit(1))})
    return placed.select(
        "conv_id", (F.col("place") - 1 + F.coalesce("place_before", F.lit(0))).alias("place"), "words",
        F.xxhash64("role", "digest").alias("e1"), F.xxhash64("digest", F.lit(1), "role").alias("e2"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its base in place of its own first ones; `place` is new."""
    ids = turns.select("conv_id").distinct().withColumns({
        "h": shared_turns(F.col("conv_id")), "base": base_of(F.col("conv_id"))})
    opening = turns.where((F.col("conv_id") % 20 == 0) & (F.col("place") < 3)).withColumnRenamed("conv_id", "base")
    taken = ids.join(opening, "base").where(F.col("place") < F.col("h"))
    sizes = opening.groupBy("base").agg(F.count(F.lit(1)).alias("n_base"))
    shift = ids.join(sizes, "base", "left").select(
        F.col("conv_id").alias("_id"), "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    own = turns.join(shift, F.col("conv_id") == F.col("_id")).where(F.col("place") >= F.col("h")).withColumn(
        "place", F.col("place") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "place", "words", "e1", "e2"]
    return taken.select(columns).unionByName(own.select(columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """A row per turn with the 128-bit digest of the sequence up to it (x1, x2) and up to its parent (p1, p2).

    A digest is the exclusive or of the hashes of its turns, each hashed with its place: it is summed in
    blocks, so that a conversation of any length is hashed by many tasks.
    """
    placed = turns.withColumns({"x1": F.xxhash64("place", "e1", "e2"), "x2": F.xxhash64("e2", "e1", "place", F.lit(2))})
    amounts = {"x1": F.bit_xor("x1"), "x2": F.bit_xor("x2")}
    own = placed.withColumnsRenamed({"x1": "t1", "x2": "t2"}).withColumns({"x1": F.col("t1"), "x2": F.col("t2")})
    summed = running(own, "conv_id", F.shiftright("place", BLOCK_BITS), ["place"], amounts)
    whole = lambda n: F.col(n).bitwiseXOR(F.coalesce(f"{n}_before", F.lit(0)))
    return summed.select(
        "conv_id", (F.col("place") + 1).alias("depth"), whole("x1").alias("x1"), whole("x2").alias("x2"),
        whole("x1").bitwiseXOR(F.col("t1")).alias("p1"), whole("x2").bitwiseXOR(F.col("t2")).alias("p2"), "words")


def digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each sequence, which come in order; only the running digest is kept."""
    key, digest = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        columns = [pa.array([k], t) for k, t in zip(key, (pa.int64(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([digest.hexdigest()])], names=[*KEY, "ends_sha256"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for here, piece in zip(zip(*columns), batch.column(4)):
            if here != key:
                if key is not None:
                    yield row()
                key, digest = here, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py().encode())
    if key is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids that end at each sequence.

    Ids are joined in pieces of bounded ranges of ids, wherever those lie; a sequence that ends any share
    of the conversations is hashed from its pieces, in order, with one piece in memory.
    """
    piece = F.shiftright("conv_id", PIECE_BITS)
    pieces = ends.groupBy(*KEY, piece.alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "piece", "ids").mapInArrow(
        digest_pieces, "depth long, x1 long, x2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, from the textless root on.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, each node's other members times the words of its last text)
    and ends_sha256 (of the ascending, comma-joined ids of the members that end there).

    Turns are ordered by number, null first, then by role and the text's MD5. A conversation starts with
    the first h turns of the conversation whose id is the next lower multiple of 20, h being crc32 of its own
    id modulo 4, and goes on after its own first h turns. Conversations that are equal when rebuilt
    collapse into a sequence with a weight, represented by their smallest id; an anti-join with the
    proper prefixes of all sequences leaves the leaves; weighted prefixes are aggregated to nodes. A node
    belongs to its smallest id, whose nodes form one chain down to its end, so that sums over subtrees
    are sums of whole chains and of one chain's end.

    Null roles and texts are empty ones. Rows without conv_id are left out: they are no conversation's.
    Repeated rows are turns of their own. An empty table has no node. Long texts are hashed where they
    lie and never move. Long conversations are numbered, hashed and summed in blocks of 256 turn
    numbers. Columns but conv_id, turn, role and text are not read.
    """
    shared_dir(conversations.sparkSession)
    turns = numbered(conversations).checkpoint()
    rows = prefixes(rebuilt(turns)).checkpoint()

    # Identical conversations become one sequence with a weight; a conversation without turns ends at the root.
    deepest = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end"))
    ends = turns.select("conv_id").distinct().join(deepest, "conv_id", "left").select(
        "conv_id", *[F.coalesce(f"end.{k}", F.lit(0).cast("long")).alias(k) for k in KEY]).checkpoint()
    sequences = ends.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")).checkpoint()
    whole = sequences.select("conv_id", "weight", F.col("depth").alias("n_turns"))
    none = F.lit(None).cast("long")
    roots = whole.select(
        "conv_id", *[F.lit(0).cast("long").alias(k) for k in KEY], none.alias("p1"), none.alias("p2"),
        F.lit(0).cast("long").alias("words"), "weight", "n_turns")
    steps = rows.join(whole, "conv_id").unionByName(roots).checkpoint()

    nodes = steps.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).checkpoint()

    # Leaves: sequences that are no proper prefix of another one.
    proper = steps.where(F.col("depth") < F.col("n_turns")).select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("chain_saved"))
    shares = leaves.join(chains.where("chain_saved > 0"), "conv_id", "full").select("conv_id", "leaf", "chain_saved")
    below = steps.join(shares, "conv_id").groupBy(*KEY).agg(
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.coalesce("chain_saved", F.lit(0))).alias("all_saved"))

    # Within a chain a node's parent is the chain's own; the parent of its top is looked up.
    tops = nodes.join(chains.select("conv_id", "top"), "conv_id").where((F.col("depth") == F.col("top")) & (F.col("depth") > 0))
    above = tops.select(F.col("conv_id").alias("_id"), (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    over = above.join(nodes.select(*KEY, F.col("conv_id").alias("above")), KEY).select(F.col("_id").alias("conv_id"), "above")
    known = chains.join(over, "conv_id", "left")
    summed = running(
        nodes, "conv_id", -F.shiftright("depth", BLOCK_BITS), [F.col("depth").desc()], {"rest": F.sum("saved")},
        more=lambda blocks: blocks.join(known, "conv_id"))
    own = F.col("rest") + F.coalesce("rest_before", F.lit(0))

    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    out = summed.join(below, KEY).join(children, KEY, "left").join(end_digests(ends), KEY, "left")
    return out.select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
        (F.col("all_saved") - F.col("chain_saved") + own).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
