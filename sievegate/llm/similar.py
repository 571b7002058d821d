"""Near-duplicate join on word shingles by chosen paths: split on sampled shared tokens, then compare."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import apart, as_bytes, map_batches, word_hashes
from sievegate.session import shared_dir

SHINGLE = 5
LEVEL = 0.8
#: Sampled tokens per set: the first ones are the paths of the runs, all of them estimate likeness.
SKETCH = 32
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Different runs of `width` words, as sorted numbers; a shorter text is one run of its own."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = (total ^ words[k:len(words) - size + 1 + k]) * MIX[k % len(MIX)]
        total ^= total >> np.uint64(31)
    return np.unique(total)


def sketch_seeds() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20260101).integers(0, 2**63, (2, SKETCH, 1)).astype(np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def sample_tokens(tokens: np.ndarray, seeds) -> np.ndarray:
    """One token per coordinate: the smallest under that coordinate's hash, as a 32-bit number."""
    mixed = tokens[None, :] * seeds[0] + seeds[1]
    mixed ^= mixed >> np.uint64(29)
    mixed *= MIX[1]
    return (mixed.min(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def runs_for(recall: float, level: float, depth: int) -> int:
    """Runs after which a pair at `level` shared a bucket with probability `recall`, `depth` levels down."""
    return math.ceil(math.log(1 - recall) / math.log(1 - level**depth))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def sign(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row key, fingerprint of the shingle set (null without words), its size and its sketch."""

    def start():
        seeds = sketch_seeds()

        def work(texts):
            prints, sizes, sketches = [], [], []
            for text in texts.to_pylist():
                tokens = shingles(text, width)
                sizes.append(len(tokens))
                prints.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                sketches.append(sample_tokens(tokens, seeds) if len(tokens) else None)
            return prints, sizes, sketches

        return work

    rows = docs.select("doc_id", row_key().alias("row"), "text")
    return map_batches(rows, [as_bytes()], "print binary, n_tokens int, sketch array<int>", start, ("text",))


def choose_paths(sets: DataFrame, runs: int, depth: int, limit: int) -> DataFrame:
    """(print, run, leaf, members): the bucket of each set in each run.

    A run puts sets with the same sampled token together. Buckets of more than `limit` sets are split
    by the next token, down to `depth` tokens. Only buckets are counted, never gathered.
    """
    tokens = [F.element_at("sketch", F.col("run") * depth + 1 + d) for d in range(depth)]
    rows = sets.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).select(
        "print", "run", *[t.alias(f"_t{d}") for d, t in enumerate(tokens)],
        F.xxhash64("run", tokens[0]).alias("leaf"))
    for level in range(1, depth):
        large = rows.groupBy("leaf").count().where(F.col("count") > limit).select(
            "leaf", F.lit(True).alias("_large")).checkpoint()
        found = large.count()
        if not found:
            break
        # At most all rows / limit buckets are large; a bounded number of them is broadcast.
        large = F.broadcast(large) if found <= 100_000 else large
        rows = rows.join(large, "leaf", "left").withColumn(
            "leaf", F.when(F.col("_large"), F.xxhash64("leaf", f"_t{level}")).otherwise(F.col("leaf"))
        ).drop("_large")
    rows = rows.select("print", "run", "leaf")
    members = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    return rows.join(members, "leaf")


def cells(paths: DataFrame, limit: int) -> DataFrame:
    """Work units: a bucket, or each pair of blocks of a bucket that is still larger than `limit`."""
    blocks = F.ceil(F.col("members") / limit).cast("int")
    dealt = paths.withColumns({"_blocks": blocks, "block": F.pmod(F.xxhash64("print"), blocks).cast("int")})
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    return dealt.withColumns({
        "cell": F.xxhash64("leaf", low, high), "cross": low != high,
    }).select("print", "run", "cell", "block", "cross")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one cell at a time, from batches sorted by cell."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("cell").to_numpy()
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            if held and keys[begin] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def column_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1)


def open_pairs(cell: pa.Table, level: float, least: int) -> np.ndarray:
    """Which pairs of a cell are to be compared here: likely alike, and in no bucket of an earlier run.

    A pair that shares buckets in several runs is compared and counted in the first of them alone.
    """
    sketch, leaves = column_matrix(cell["sketch"]), column_matrix(cell["leaves"])
    size = cell["n_tokens"].to_numpy()
    run = cell["run"][0].as_py()
    n = len(size)
    pairs = np.triu(np.ones((n, n), dtype=bool), 1)
    if cell["cross"][0].as_py():
        block = cell["block"].to_numpy()
        pairs &= block[:, None] != block[None, :]
    pairs &= np.minimum(size[:, None], size[None, :]) >= level * np.maximum(size[:, None], size[None, :]) - 1e-9
    for r in range(run):
        pairs &= leaves[:, None, r] != leaves[None, :, r]
    alike = np.zeros((n, n), dtype=np.int16)
    for k in range(sketch.shape[1]):
        alike += sketch[:, None, k] == sketch[None, :, k]
    return pairs & (alike >= least)


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, through the tokens that at least two sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(times > 1) - 1
    keep = times[token] > 1
    token, owner = often[token[keep]], owner[keep]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for begin in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [begin, begin + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], token[a:b] - begin] = 1
        total += part @ part.T
    return total


def roots(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def connect(edges: DataFrame) -> DataFrame:
    """(print, root) of every linked set, by large and small stars until nothing changes.

    Each round is checkpointed. Hot sets are only ever grouped for a minimum and joined.
    """

    def check(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = edges.checkpoint()
    before = None
    while (now := check(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_least"))
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("_least").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b")).where("a <> b")
        own = least.select("a", F.col("_least").alias("b"))
        edges = small.unionByName(own).distinct().checkpoint()
    return edges.select(F.col("a").alias("print"), F.col("b").alias("root"))


def link(docs: DataFrame, sets: DataFrame, level: float, width: int, recall: float, depth: int, limit: int) -> DataFrame:
    """(a, b, texts, copies): per cell and set, the cell's root it is tied to and what it links to."""
    runs = runs_for(recall, level, depth)
    if runs * depth > SKETCH:
        raise ValueError(f"{runs} runs of {depth} levels need {runs * depth} sampled tokens")
    # Of a pair at `level`, fewer than `least` equal sampled tokens have a probability below 1e-4.
    least = next(k for k in range(SKETCH + 1) if sum(
        math.comb(SKETCH, i) * level**i * (1 - level)**(SKETCH - i) for i in range(k + 1)) > 1e-4)
    paths = choose_paths(sets, runs, depth, limit)
    leaves = paths.groupBy("print").agg(F.map_from_entries(F.collect_list(F.struct("run", "leaf"))).alias("_leaf"))
    # A run whose bucket holds the set alone has no leaf; its own print stands for it.
    alone = F.xxhash64("print")
    described = sets.join(leaves, "print").select(
        "print", "row", "n_tokens", "copies", "sketch",
        F.array(*[F.coalesce(F.element_at("_leaf", F.lit(r)), alone + r) for r in range(runs)]).alias("leaves"))
    rows = cells(paths, limit).join(described, "print")
    schema = rows.schema

    def need(batches):
        for cell in by_cell(batches):
            pairs = open_pairs(cell, level, least)
            wanted = np.nonzero(pairs.any(axis=0) | pairs.any(axis=1))[0]
            if len(wanted):
                yield from cell.take(pa.array(wanted)).to_batches()

    needed = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(need, schema).checkpoint()
    found = needed.select("row").distinct()
    # Texts are fetched for likely pairs only; with few of them the rows' keys go to the texts.
    texts = docs.select(row_key().alias("row"), as_bytes().alias("text"))
    few = found.count() <= 1_000_000
    fetched = texts.join(F.broadcast(found), "row") if few else texts.join(found, "row")
    fetched = fetched.dropDuplicates(["row"])

    def compare(batches):
        for cell in by_cell(batches):
            pairs = open_pairs(cell, level, least)
            if not pairs.any():
                continue
            sets_ = [shingles(t, width) for t in cell["text"].to_pylist()]
            shared = shared_counts(sets_)
            size = np.array([len(s) for s in sets_], dtype=np.float64)
            union = size[:, None] + size[None, :] - shared
            linked = pairs & (shared >= level * union - 1e-9)
            linked |= linked.T
            left, right = np.nonzero(np.triu(linked))
            root = roots(len(size), left, right)
            copies = cell["copies"].to_numpy()
            ids = cell["print"]
            rows = np.nonzero(linked.any(axis=1))[0].tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i].as_py() for i in rows], pa.binary()),
                pa.array([ids[root[i]].as_py() for i in rows], pa.binary()),
                pa.array(linked.sum(axis=1)[rows], pa.int64()),
                pa.array((linked @ copies)[rows], pa.int64()),
            ], names=["a", "b", "texts", "copies"])

    work = needed.join(fetched, "row").repartition("cell").sortWithinPartitions("cell")
    return work.mapInArrow(compare, "a binary, b binary, texts long, copies long")


def near_duplicates(
    docs: DataFrame, level: float = LEVEL, width: int = SHINGLE, recall: float = 0.999, depth: int = 2, limit: int = 400,
) -> DataFrame:
    """(doc_id, row, class_id, rep_id, copies, n_links, n_texts) for every document.

    Texts are alike if the Jaccard similarity of their sets of `width`-word shingles is `level` or
    more; words are lower-cased runs of digits, letters and characters outside ASCII. Texts with
    one set are copies and are compared once. Candidate pairs come from the chosen paths and are
    verified on the whole texts, so every link is real; a pair at `level` is missed with a
    probability of 1 - `recall` at most, alike ones less.
    rep_id is the smallest doc_id with the same set, copies their number; n_texts counts the linked
    other sets, n_links all linked documents, own copies included. class_id is the smallest doc_id
    of all documents tied by links. Nulls and texts without words are alike to nothing: a class of
    their own. A null doc_id is in a class but does not name it. Repeated rows are copies; an empty
    table stays empty.
    """
    shared_dir(docs.sparkSession)
    signed = sign(docs, width).checkpoint()
    with_words = signed.where(F.col("print").isNotNull())
    sets = with_words.groupBy("print").agg(
        F.min("doc_id").alias("rep_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"),
        F.min("n_tokens").alias("n_tokens"), F.first("sketch").alias("sketch")).checkpoint()
    links = link(docs, sets, level, width, recall, depth, limit).checkpoint()
    counts = links.groupBy(F.col("a").alias("print")).agg(
        F.sum("texts").alias("n_texts"), F.sum("copies").alias("linked"))
    tied = connect(links)
    tied = tied.unionByName(tied.select(F.col("root").alias("print"), "root").distinct())
    named = tied.join(sets.select("print", "rep_id"), "print")
    names = named.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    classes = tied.join(names, "root").select("print", "class_id").join(counts, "print")
    about = sets.select("print", "rep_id", "copies").join(classes, "print", "left")
    known = with_words.select("doc_id", "row", "print").join(about, "print").select(
        "doc_id", "row", F.coalesce("class_id", "rep_id").alias("class_id"), "rep_id", "copies",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    lone = signed.where(F.col("print").isNull()).select(
        "doc_id", "row", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"),
        F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_texts"))
    return known.unionByName(lone)


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One document of each class of near-duplicates, columns as given.

    The document with the smallest doc_id stays, a null one last; of repeated rows one stays.
    Documents without words stay all. Only the keys of rows that go are joined with the texts.
    """
    renamed, back = apart(docs)
    keyed = renamed.withColumn("doc_id", F.col(renamed.columns[docs.columns.index("doc_id")]))
    near = near_duplicates(keyed.select("doc_id", "text"), **settings)
    grouped = near.where((F.col("copies") > 1) | (F.col("n_texts") > 0)).withColumn(
        "_first", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    named = grouped.where(F.col("class_id").isNotNull())
    first = named.groupBy("class_id").agg(F.min("_first").alias("_first"))
    gone = named.join(first.select("class_id", F.col("_first.row").alias("_kept")), "class_id").where(
        "row <> _kept").select("row").distinct().checkpoint()
    twice = grouped.groupBy("row").count().where(F.col("count") > 1).select("row").checkpoint()
    rows = keyed.withColumn("_row", row_key())
    few = gone.count() <= 1_000_000
    left = rows.join(F.broadcast(gone) if few else gone, F.col("_row") == F.col("row"), "left_anti")
    if not twice.isEmpty():
        repeated = F.broadcast(twice) if twice.count() <= 1_000_000 else twice
        on = F.col("_row") == F.col("row")
        single = left.join(repeated, on, "left_anti")
        left = single.unionByName(left.join(repeated, on, "left_semi").dropDuplicates(["_row"]))
    return back(left)
