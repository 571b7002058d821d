"""Many queries against many chunks: lexical, semantic, fused and gated search.

Tables: chunks (chunk_id, chunk_text, ...), queries (query_id, text, ...).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sievegate.functions import fixed_values as fixed
from sievegate.functions import scoring as sc
from sievegate.functions import text as tx
from sievegate.operators.common import salted_join, small_rows, spread, top_k, unnest
from sievegate.session import shared_dir

QUERY_TERMS_BROADCAST = 200_000  # rows of (query, token)
QUERY_VECTORS_BROADCAST = 4_096  # query vectors per broadcast block
SCORE_DIGITS = 9                 # so that equal texts get equal scores in any order of addition
SCORED_TERMS = 2_000_000         # (chunk, term of a query) pairs that a task scores at once
SHARD_ROWS = 20_000              # chunk vectors per grid cell


# ---- lexical ----------------------------------------------------------------------

def token_rows(chunks: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """chunk_id, _t: tokens of every chunk, where the chunk lies.

    No token array is shuffled: counts are summed in the task that reads the text, and
    only sums per token, or the tokens somebody asks for, move.
    """
    return chunks.select("chunk_id", tx.search_tokens(text_col).alias("_t"))


def token_table(chunks: DataFrame, text_col: str = "chunk_text", wanted: DataFrame | None = None) -> DataFrame:
    """chunk_id, dl, token, tf, of all tokens or of the `wanted` ones (token; to be broadcast)."""
    rows = unnest(token_rows(chunks, text_col), ["chunk_id", F.size("_t").alias("dl")], "_t", "token")
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted), "token", "left_semi")
    return rows.groupBy("chunk_id", "dl", "token").agg(F.count("*").alias("tf"))


def vocabulary(chunks: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """token, df, total; the empty token stands for the corpus: chunks with tokens, and all tokens.

    One pass over the texts, summed before the shuffle, serves both statistics.
    """
    tokens = F.concat(F.array_distinct("_t"), F.array(F.lit("")))
    rows = unnest(token_rows(chunks, text_col), [F.size("_t").alias("dl")], tokens, "token")
    return rows.groupBy("token").agg(F.count_if(F.col("dl") > 0).alias("df"), F.sum("dl").alias("total"))


def corpus_stats(chunks: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """One row: n_chunks and avg_length over chunks with tokens."""
    return vocabulary(chunks, text_col).where("token = ''").agg(
        F.coalesce(F.sum("df"), F.lit(0)).alias("n_chunks"),
        (F.sum("total") / F.nullif(F.sum("df"), F.lit(0))).alias("avg_length"),
    )


def token_idf(chunks: DataFrame, n_chunks: Column, text_col: str = "chunk_text") -> DataFrame:
    """token, df, idf; a negative idf becomes a share of the mean over the vocabulary."""
    df = vocabulary(chunks, text_col).where("token <> ''").select("token", "df")
    raw = df.withColumn(
        "idf", F.log(n_chunks - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    floor = raw.select(fixed.BM25_EPSILON * F.avg("idf")).scalar()
    return raw.withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, token, times for every query."""
    rows = unnest(
        queries.select("query_id", tx.search_tokens("text").alias("_t")), ["query_id"], "_t", "token"
    )
    return rows.groupBy("query_id", "token").agg(F.count("*").alias("times"))


def weighted_terms(chunks: DataFrame, terms: DataFrame, text_col: str = "chunk_text") -> tuple[DataFrame, float]:
    """query_id, token, weight (idf by times) of the terms that occur, and the mean length of the chunks.

    The vocabulary is summed once and kept; counts, mean idf and weights are read from it.
    """
    shared_dir(chunks.sparkSession)
    words = vocabulary(chunks, text_col).checkpoint()
    corpus = words.where("token = ''").select("df", "total").first()
    n_chunks = corpus["df"] if corpus else 0
    average = corpus["total"] / n_chunks if n_chunks else 1.0
    raw = words.where("token <> ''").select(
        "token", (F.log(F.lit(n_chunks) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    floor = raw.select(fixed.BM25_EPSILON * F.avg("idf")).first()[0]
    idf = F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf"))
    return raw.join(terms, "token").select("query_id", "token", (idf * F.col("times")).alias("weight")), average


def _counted_terms(vocabulary: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id, dl, terms, counts: places in the vocabulary of the words of a chunk that are in it."""
    for batch in batches:
        tokens = batch.column("_t")
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.fill_null(pc.index_in(tokens.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(found >= 0)
        keys, counts = np.unique(
            np.repeat(np.arange(len(sizes)), sizes)[at] * len(vocabulary) + found[at], return_counts=True)
        rows, starts = np.unique(keys // len(vocabulary), return_index=True)
        ends = pa.array(np.append(starts, len(keys)), pa.int32())
        yield pa.RecordBatch.from_arrays([
            batch.column("chunk_id").take(pa.array(rows)), pa.array(sizes[rows], pa.int32()),
            pa.ListArray.from_arrays(ends, pa.array(keys % len(vocabulary), pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=["chunk_id", "dl", "terms", "counts"])


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of chunks, and place, length, term, count of their terms, from rows sorted by chunk_id.

    Rows of one chunk with the same length count as one text. The last chunk of a batch waits for the
    next one, with its counts summed.
    """
    def merged(place, length, term, count):
        order = np.lexsort((term, length, place))
        place, length, term, count = place[order], length[order], term[order], count[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(place) != 0) | (np.diff(length) != 0) | (np.diff(term) != 0)
        first = np.flatnonzero(new)
        return place[first], length[first], term[first], np.add.reduceat(count, first) if len(first) else count

    last, waiting = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("chunk_id")
        if last is not None:
            ids = pa.concat_arrays([last, ids])
        listed = ids.to_pylist()
        place = np.cumsum([0, *(a != b for a, b in zip(listed, listed[1:]))])
        firsts = ids.take(pa.array(np.flatnonzero(np.diff(place, prepend=-1))))
        own = place[len(ids) - batch.num_rows:]
        sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        rows = (np.repeat(own, sizes), np.repeat(batch.column("dl").to_numpy(), sizes),
                batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        if waiting is not None:
            rows = tuple(np.concatenate(pair) for pair in zip(waiting, rows))
        rows = merged(*rows)
        cut = np.searchsorted(rows[0], place[-1])
        if place[-1]:
            yield firsts.slice(0, len(firsts) - 1), *(r[:cut] for r in rows)
        last = firsts.slice(len(firsts) - 1)
        waiting = (np.zeros(len(rows[0]) - cut, np.int64), *(r[cut:] for r in rows[1:]))
    if last is not None:
        yield last, *waiting


def _scored_chunks(
    asked: pa.Array, pointers: np.ndarray, query_of: np.ndarray, weights: np.ndarray, average: float, k: int | None,
    batches: Iterator[pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """query_id, chunk_id, raw_score > 0 of a task's chunks, or the `k` best of them per query.

    `query_of` and `weights` list the queries of each term, between its `pointers`. Chunks come by id, so
    of equal scores the earlier one stays.
    """
    k1, b = fixed.BM25_K1, fixed.BM25_B
    step = max(1, SCORED_TERMS // max(1, len(weights)))
    least = np.zeros(len(asked))
    kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    held = 0

    def batch_of(query, score, ids):
        return pa.RecordBatch.from_arrays(
            [asked.take(pa.array(query)), ids, pa.array(score)], names=["query_id", "chunk_id", "raw_score"])

    def best():
        query, score = (np.concatenate([part[i] for part in kept]) for i in (0, 1))
        order = np.lexsort((np.arange(len(query)), -score, query))
        starts = np.searchsorted(query[order], np.arange(len(asked)))
        place = np.arange(len(order)) - starts[query[order]]
        ended = order[place == k - 1]
        least[query[ended]] = score[ended]
        keep = np.sort(order[place < k])
        ids = pa.concat_arrays([part[2] for part in kept]).take(pa.array(keep))
        return query[keep], score[keep], ids

    for ids, place, length, term, count in _whole_chunks(batches):
        for start in range(0, len(ids), step):
            n = min(step, len(ids) - start)
            low, high = np.searchsorted(place, [start, start + n])
            t, tf = term[low:high], count[low:high].astype(float)
            below = tf + k1 * (1 - b + b * length[low:high] / average)
            times = pointers[t + 1] - pointers[t]
            ends = np.cumsum(times)
            each = np.repeat(np.arange(len(t)), times)
            at = np.arange(len(each)) - np.repeat(ends - times, times) + pointers[t][each]
            part = weights[at] * tf[each] * (k1 + 1) / below[each]
            cell = (place[low:high][each] - start) * len(asked) + query_of[at]
            scores = np.round(np.bincount(cell, part, n * len(asked)), SCORE_DIGITS).reshape(n, len(asked))
            row, query = np.nonzero((scores > 0) & ((scores > least) | (least == 0)))
            if not len(row):
                continue
            found = (query, scores[row, query], ids.take(pa.array(row + start)))
            if k is None:
                yield batch_of(*found)
                continue
            kept.append(found)
            held += len(row)
            if held > max(SCORED_TERMS, 2 * k * len(asked)):
                kept = [best()]
                held = len(kept[0][0])
    if kept:
        yield batch_of(*best())


def _scored_terms(chunks: DataFrame, queries: DataFrame, rows: list, average: float, text_col: str, k: int | None) -> DataFrame:
    """query_id, chunk_id, raw_score by `rows` (query_id, token, weight); with `k` the best of every task."""
    if not rows:
        return chunks.limit(0).select(
            F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "chunk_id", F.lit(0.0).alias("raw_score"))
    words = sorted({r["token"] for r in rows})
    places = {word: i for i, word in enumerate(words)}
    ids = list(dict.fromkeys(r["query_id"] for r in rows))
    numbers = {query: i for i, query in enumerate(ids)}
    term, query = (np.array([known[r[name]] for r in rows]) for known, name in ((places, "token"), (numbers, "query_id")))
    order = np.lexsort((query, term))
    pointers = np.searchsorted(term[order], np.arange(len(words) + 1))
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    sent = chunks.sparkSession.sparkContext.broadcast((
        pa.array(words, pa.string()), pa.array(ids, kind), pointers, query[order], np.array([r["weight"] for r in rows])[order]))
    of_id = chunks.schema["chunk_id"].dataType
    counted = T.StructType([
        T.StructField("chunk_id", of_id), T.StructField("dl", T.IntegerType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    scored = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", of_id),
        T.StructField("raw_score", T.DoubleType())])
    met = token_rows(chunks, text_col).mapInArrow(lambda batches: _counted_terms(sent.value[0], batches), counted)
    return met.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(
        lambda batches: _scored_chunks(*sent.value[1:], average, k, batches), scored)


def bm25_scores(
    chunks: DataFrame, queries: DataFrame, text_col: str = "chunk_text", k: int | None = None,
) -> DataFrame:
    """query_id, chunk_id, raw_score > 0 over the given chunks.

    Statistics come from exactly these chunks, so filter them first to score a
    scope. When the query terms are few, they go to every task: a chunk becomes one
    row of its own counts of them, and no pair of chunk and query is a row before it is scored. With `k`
    a task keeps the best of its chunks per query, and the few rows that are left are kept as a checkpoint;
    chunks with the same id lie in one task, as one chunk. Otherwise terms and tokens
    meet in a salted join, because one token may be in a third of all chunks.
    """
    terms = query_terms(queries)
    few = terms.limit(QUERY_TERMS_BROADCAST + 1).count() <= QUERY_TERMS_BROADCAST
    weighted, average = weighted_terms(chunks, F.broadcast(terms) if few else terms, text_col)
    if few:
        found = _scored_terms(chunks, queries, small_rows(weighted, QUERY_TERMS_BROADCAST), average, text_col, k)
        return found if k is None else found.checkpoint()
    hits = salted_join(token_table(chunks, text_col), weighted, ["token"], "chunk_id")
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = (
        F.col("weight") * F.col("tf") * (k1 + 1)
        / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
    )
    return (
        hits.groupBy("chunk_id", "query_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("raw_score"))
        .where("raw_score > 0").select("query_id", "chunk_id", "raw_score")
    )


def bm25_top(
    chunks: DataFrame, queries: DataFrame, k: int = fixed.LEXICAL_CANDIDATES,
    text_col: str = "chunk_text",
) -> DataFrame:
    """Ranked lexical list per query with the distance relative to its best row."""
    order = [F.col("raw_score").desc(), F.col("chunk_id").asc()]
    best = top_k(bm25_scores(chunks, queries, text_col, k), ["query_id"], order, k)
    lead = F.max("raw_score").over(Window.partitionBy("query_id"))
    return best.select(
        "query_id", "chunk_id", "rank", "raw_score",
        F.greatest(F.lit(0.0), 1.0 - F.col("raw_score") / lead).alias("distance"),
    )


def word_grams(word: Column, short: bool = True) -> Column:
    """Distinct runs of three characters of a word, and of two where `short` asks for them or it has no more."""
    runs = lambda q: F.when(F.length(word) >= q, F.transform(
        F.sequence(F.lit(1), F.length(word) - (q - 1)), lambda i: F.substr(word, i, F.lit(q)))).otherwise(F.array())
    return F.array_distinct(F.concat(runs(2), runs(3)) if short else F.when(F.length(word) == 2, runs(2)).otherwise(runs(3)))


def containing_words(words: DataFrame, parts: DataFrame) -> DataFrame:
    """main, word: which of the distinct `words` (word) contain which of the distinct `parts` (main).

    Words are indexed by their runs of two and three characters; a part is looked up by the one of its
    runs that the fewest words have, so its candidates do not grow with common endings. A part
    has two characters or more and no white space.
    """
    asked = unnest(parts, ["main"], word_grams(F.col("main"), False), "gram").select("main", "gram").checkpoint()
    short = not asked.where(F.length("gram") == 2).isEmpty()
    grams = asked.select("gram").distinct()
    few = grams.limit(QUERY_TERMS_BROADCAST + 1).count() <= QUERY_TERMS_BROADCAST
    index = unnest(words, ["word"], word_grams(F.col("word"), short), "gram").select("word", "gram").join(
        F.broadcast(grams) if few else grams, "gram", "left_semi").checkpoint()
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n_words"))
    rarest = asked.join(sizes, "gram").groupBy("main").agg(
        F.min(F.struct("n_words", "gram")).alias("best"), F.count(F.lit(1)).alias("n_known")).join(
        asked.groupBy("main").agg(F.count(F.lit(1)).alias("n_grams")), "main").where("n_known = n_grams").select(
        "main", "best.gram")
    return index.join(rarest, "gram").where(F.col("word").contains(F.col("main"))).select("main", "word")


def token_f1_top(
    chunks: DataFrame, queries: DataFrame, k: int = fixed.DEFAULT_TOP_K, text_col: str = "chunk_text",
) -> DataFrame:
    """Accent-blind token F1 over chunks that contain the query's longest token;
    over all chunks for queries whose token is in none.

    A longest token has no white space, so a text contains it exactly if one of its words does: it is
    resolved on the distinct words of the corpus, once, by their character runs. Texts are read
    twice, for the distinct words and for the few that some query needs, whatever the number of
    queries. A chunk knows the longest tokens it contains before it meets a query, and no pair
    without a common token, or ruled out by the longest one, is built.
    """
    shared_dir(chunks.sparkSession)
    prepared = queries.select(
        "query_id", tx.search_tokens(tx.strip("text")).alias("_t")
    ).where(F.size("_t") > 0).select(
        "query_id",
        tx.longest_token(tx.drop_stopwords(F.col("_t"))).alias("main"),
        F.array_distinct(F.transform("_t", tx.strip_accents)).alias("_set"),
    ).checkpoint()
    own = F.lower("word")
    token = F.when(F.length(own) > 1, tx.strip_accents(own))
    raw = F.array_distinct(tx.words(text_col))
    # Few bytes, but much work on each: dealt out in spite of the size.
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = unnest(chunks.select(text_col), [], raw, "word").select("word").distinct().repartition(
        parts, "word").withColumn("token", token).checkpoint()
    holders = containing_words(words, prepared.select("main").distinct()).checkpoint()
    found = holders.select("main").distinct().withColumn("_found", F.lit(True))
    terms = unnest(prepared, ["query_id", "main", F.size("_set").alias("n_query")], "_set", "token").join(
        found, "main", "left").checkpoint()

    named = words.join(terms.select("token").distinct(), "token", "left_semi").select("word").unionByName(
        holders.select("word")).distinct().checkpoint()
    few = named.limit(QUERY_TERMS_BROADCAST + 1).count() <= QUERY_TERMS_BROADCAST
    n_text = F.size(F.array_distinct(F.transform(tx.search_tokens(text_col), tx.strip_accents)))
    read = unnest(chunks, ["chunk_id", n_text.alias("n_text")], raw, "word").select("chunk_id", "n_text", "word")
    met = read.join(F.broadcast(named) if few else named, "word").checkpoint()

    held = met.select("chunk_id", "word").join(holders, "word").groupBy("chunk_id").agg(F.collect_set("main").alias("_hit"))
    tokens = met.select("chunk_id", "n_text", token.alias("token")).where("token IS NOT NULL").distinct().join(
        held, "chunk_id", "left")
    few = terms.limit(QUERY_TERMS_BROADCAST + 1).count() <= QUERY_TERMS_BROADCAST
    pairs = tokens.join(F.broadcast(terms), "token") if few else salted_join(tokens, terms, ["token"], "chunk_id")
    allowed = F.col("_found").isNull() | F.coalesce(F.array_contains("_hit", F.col("main")), F.lit(False))
    counted = pairs.where(allowed).groupBy("chunk_id", "query_id", "n_query", "n_text").agg(F.count("*").alias("both"))
    p, r = F.col("both") / F.col("n_text"), F.col("both") / F.col("n_query")
    scored = counted.select("query_id", "chunk_id", (2 * p * r / F.greatest(F.lit(1e-9), p + r)).alias("f1"))
    order = [F.col("f1").desc(), F.col("chunk_id").asc()]
    return top_k(scored, ["query_id"], order, k).select(
        "query_id", "chunk_id", "rank", "f1", (1.0 - F.col("f1")).alias("distance")
    )


# ---- semantic -----------------------------------------------------------------------

def _unit_rows(vectors, width: int) -> np.ndarray:
    """Rows scaled to length one; unusable vectors become zero rows."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = v
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _best_of_block(sims: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query row the k best (similarity, id), ties by smaller id."""
    out = []
    for row, row_ids in zip(sims, ids):
        if len(row) > k:
            cut = np.partition(row, len(row) - k)[len(row) - k]
            keep = np.flatnonzero(row >= cut)
        else:
            keep = np.arange(len(row))
        order = np.lexsort((row_ids[keep], -row[keep]))[:k]
        out.append((row[keep][order], row_ids[keep][order]))
    return out


def _by_length(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit rows of the vectors of each length."""
    lengths = np.array([len(v) for v in vectors])
    return {
        int(n): (at, _unit_rows([vectors[i] for i in at], int(n)))
        for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}


def _scan_block(query_ids, groups, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Local k best per query over all batches of one task; vectors of unequal length score 0."""
    best = None
    for batch in batches:
        if batch.empty:
            continue
        sims = np.zeros((len(query_ids), len(batch)))
        for length, (at, rows) in _by_length(batch["embedding"].to_numpy()).items():
            if length in groups:
                asked, matrix = groups[length]
                sims[np.ix_(asked, at)] = np.round(matrix @ rows.T, 12)
        ids = batch["chunk_id"].to_numpy()
        rows = _best_of_block(sims, np.broadcast_to(ids, sims.shape), k)
        if best is not None:
            merged = [(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
                      for a, b in zip(best, rows)]
            rows = [_best_of_block(s[None, :], i[None, :], k)[0] for s, i in merged]
        best = rows
    if best is not None:
        yield pd.DataFrame({
            "query_id": np.repeat(query_ids, [len(s) for s, _ in best]),
            "chunk_id": np.concatenate([i for _, i in best]),
            "similarity": np.concatenate([s for s, _ in best]),
        })


def cosine_top(
    vectors: DataFrame, queries: DataFrame, k: int = fixed.SEMANTIC_CANDIDATES,
    block: int = QUERY_VECTORS_BROADCAST,
) -> DataFrame:
    """Exact cosine top-k: query_id, chunk_id, rank, similarity, distance.

    `vectors`: chunk_id, embedding; `queries`: query_id, embedding. A block of
    query vectors that fits the bound goes to every task, which multiplies it with
    its own chunk vectors and keeps k rows per query: only those are shuffled.
    More queries than one block meet the chunks in a grid of bounded cells.
    """
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])
    slim = vectors.select("chunk_id", "embedding").where(F.size("embedding") > 0)
    wanted = queries.select("query_id", "embedding").where(F.size("embedding") > 0)
    rows = small_rows(wanted, block)
    if rows is not None:
        if not rows:
            return slim.limit(0).select(
                F.lit(None).cast(schema["query_id"].dataType).alias("query_id"), "chunk_id",
                F.lit(0).alias("rank"), F.lit(0.0).alias("similarity"), F.lit(0.0).alias("distance"))
        sent = slim.sparkSession.sparkContext.broadcast(
            (np.array([r["query_id"] for r in rows]),
             _by_length([r["embedding"] for r in rows]))
        )

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, groups = sent.value
            yield from _scan_block(ids, groups, k, batches)

        local = slim.mapInPandas(scan, schema)
    else:
        local = _grid_scan(slim, wanted, k, block, schema)
    shared_dir(slim.sparkSession)
    order = [F.col("similarity").desc(), F.col("chunk_id").asc()]
    return top_k(local.checkpoint(), ["query_id"], order, k).select(
        "query_id", "chunk_id", "rank", "similarity", (1.0 - F.col("similarity")).alias("distance")
    )


def _grid_scan(slim: DataFrame, wanted: DataFrame, k: int, block: int, schema) -> DataFrame:
    """Cells of (query block, chunk shard), each a bounded block product."""
    shards = max(1, -(-slim.count() // SHARD_ROWS))
    slices = max(1, -(-wanted.count() // block))
    chunk_side = spread(slim, "chunk_id", shards).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )
    query_side = wanted.withColumn(
        "_slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({n: [] for n in schema.names})
        if queries.empty or chunks.empty:
            return empty
        found = list(_scan_block(
            queries["query_id"].to_numpy(), _by_length(queries["embedding"].to_numpy()), k, iter([chunks])))
        return found[0] if found else empty

    return query_side.groupBy("_slice", "_salt").cogroup(
        chunk_side.groupBy("_slice", "_salt")
    ).applyInPandas(cell, schema)


def hashed_embedding(c: Column | str, width: int = 64) -> Column:
    """Unit vector of hashed token counts; an empty array for blank text."""
    def slots(tokens: Column) -> Column:
        return F.transform(
            tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % width).cast("int")
        )

    def vector(hashed: Column) -> Column:
        counts = F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda i: F.size(F.filter(hashed, lambda h: h == i)).cast("double"),
        )
        return tx.let(
            counts,
            lambda v: F.transform(v, lambda x: (x / sc.norm(v)).cast("float")),
        )

    tokens = tx.search_tokens(c)
    return F.when(F.size(tokens) > 0, tx.let(slots(tokens), vector)).otherwise(
        F.array().cast("array<float>")
    )


def encode_texts(
    rows: DataFrame, make_encoder: Callable[[], Callable], text_col: str = "text", batch: int = fixed.EMBED_BATCH,
) -> DataFrame:
    """Add `embedding` by an outside encoder, and `encode_ms`, the time of the call a text was in, shared among its texts.

    `make_encoder` is called once per task and gives a function from a list of at most `batch` stripped
    texts to a list of vectors. Blank and null texts are not sent and keep their row with an empty vector.
    """
    schema = T.StructType([
        *[f for f in rows.schema.fields if f.name not in ("embedding", "encode_ms")],
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("encode_ms", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for record in batches:
            texts = [(t or "").strip() for t in record.column(text_col).to_pylist()]
            slots = [i for i, t in enumerate(texts) if t]
            vectors: list[list[float]] = [[] for _ in texts]
            took = [0.0] * len(texts)
            for start in range(0, len(slots), batch):
                part, began = slots[start:start + batch], time.perf_counter()
                for slot, vector in zip(part, encode([texts[i] for i in part]), strict=True):
                    vectors[slot] = [float(x) for x in vector]
                for slot in part:
                    took[slot] = 1000 * (time.perf_counter() - began) / len(part)
            kept = [n for n in record.schema.names if n not in ("embedding", "encode_ms")]
            yield pa.RecordBatch.from_arrays(
                [*(record.column(n) for n in kept), pa.array(vectors, pa.list_(pa.float32())), pa.array(took, pa.float64())],
                names=[*kept, "embedding", "encode_ms"])

    return rows.mapInArrow(run, schema)


def embed_texts(rows: DataFrame, encode: Callable, text_col: str = "text", batch: int = fixed.EMBED_BATCH) -> DataFrame:
    """`encode_texts` with an encoder that needs no loading, without its times."""
    return encode_texts(rows, lambda: encode, text_col, batch).drop("encode_ms")


def hashed_encoder(width: int = 64) -> Callable[[], Callable]:
    """A deterministic stand-in for a model: unit vectors of hashed word counts."""
    def make() -> Callable:
        places: dict[str, int] = {}

        def place(word: str) -> int:
            if word not in places:
                places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width
            return places[word]

        def encode(texts: list[str]) -> list[np.ndarray]:
            out = np.zeros((len(texts), width))
            for row, text in zip(out, texts):
                for word in text.lower().split():
                    if len(word) > 1:
                        row[place(word)] += 1
            length = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return list(np.divide(out, length, out=np.zeros_like(out), where=length > 0))

        return encode

    return make


# ---- fusion and scores ----------------------------------------------------------------

def ranked_lists(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    left = semantic.select(
        "query_id", "chunk_id", "rank", F.lit("semantic").alias("source"),
        F.col("distance").alias("semantic_distance"), F.lit(None).cast("double").alias("lexical_distance"),
        F.lit(None).cast("double").alias("lexical_raw"),
    )
    right = lexical.select(
        "query_id", "chunk_id", "rank", F.lit("lexical").alias("source"),
        F.lit(None).cast("double").alias("semantic_distance"), F.col("distance").alias("lexical_distance"),
        F.col("raw_score").alias("lexical_raw"),
    )
    return left.unionByName(right)


def fuse(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two lists per query."""
    return ranked_lists(semantic, lexical).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(sc.rrf("rank")), 6).alias("rrf_score"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        F.max("semantic_distance").alias("semantic_distance"),
        F.max("lexical_distance").alias("lexical_distance"),
        F.max("lexical_raw").alias("lexical_raw"),
    )


def by_mode(semantic: DataFrame, lexical: DataFrame, mode: str) -> DataFrame:
    """One result shape for the three modes; `rrf_score` is the ranking score."""
    if mode == "hybrid":
        return fuse(semantic, lexical)
    rows = ranked_lists(semantic, lexical)
    if mode == "semantic":
        score = sc.distance_to_similarity("semantic_distance")
    else:
        score = F.greatest(F.lit(0.0), 1.0 - F.col("lexical_distance"))
    wanted = "semantic" if mode == "semantic" else "lexical"
    return rows.where(F.col("source") == wanted).select(
        "query_id", "chunk_id", score.alias("rrf_score"), F.col("source").alias("sources"),
        "semantic_distance", "lexical_distance", "lexical_raw",
    )


def with_scores(fused: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Add shown score and its parts; drop rows under the minimum."""
    sim = F.when(F.col("semantic_distance").isNotNull(), sc.distance_to_similarity("semantic_distance"))
    return fused.withColumn("_sim", sim).withColumn(
        "score", sc.display_score("_sim", "lexical_raw")
    ).withColumn("semantic_score", F.round("_sim", 6)).withColumn(
        "keyword_score",
        F.when(F.col("lexical_raw").isNotNull(), F.round(sc.keyword_score("lexical_raw"), 6)),
    ).where(F.col("score") >= minimum).drop("_sim")


def fused_order() -> list[Column]:
    return [F.col("rrf_score").desc(), F.col("chunk_id").asc()]


def search(
    chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame,
    mode: str = "hybrid", k: int = fixed.DEFAULT_TOP_K, candidates: int = fixed.SEMANTIC_CANDIDATES,
) -> DataFrame:
    """Ungated search in one mode: top k per query in ranking order."""
    semantic = cosine_top(vectors, query_vectors, candidates)
    lexical = bm25_top(chunks, queries, candidates)
    k = min(k, fixed.SEARCH_CAP)
    return top_k(with_scores(by_mode(semantic, lexical, mode)), ["query_id"], fused_order(), k)


def merge_collections(lists: list[DataFrame], k: int) -> DataFrame:
    """Best k per query over result lists of several collections, by shown score."""
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.unionByName(other)
    order = [F.col("score").desc(), F.col("collection").asc(), F.col("chunk_id").asc()]
    return top_k(merged, ["query_id"], order, k)


def normalize_retrieved(
    rows: DataFrame, text_col: str = "document_text", limit: int = 5, minimum: float = 0.0,
    keep_best: bool = True,
) -> DataFrame:
    """Drop blank texts and low scores, sort by score with missing ones last, cut.

    With `keep_best`, a query whose rows all fall below the minimum keeps its best.
    """
    order = [F.col("score").desc_nulls_last(), F.col("chunk_id").asc()]
    shown = rows.withColumn(text_col, tx.strip(text_col)).where(F.col(text_col) != "")
    best = top_k(shown, ["query_id"], order, limit)
    if minimum <= 0:
        return best
    passes = F.col("score").isNull() | (F.col("score") >= minimum)
    if not keep_best:
        return top_k(shown.where(passes), ["query_id"], order, limit)
    kept = top_k(shown.where(passes), ["query_id"], order, limit)
    lone = top_k(shown, ["query_id"], order, 1).join(kept, "query_id", "left_anti")
    return kept.unionByName(lone)


# ---- gating ---------------------------------------------------------------------------

def gate_results(
    scored: DataFrame, index: DataFrame, queries: DataFrame, clearance: DataFrame,
    viewable: DataFrame, grants: DataFrame,
) -> DataFrame:
    """Access flags per result row; rows the user may not even see as restricted go.

    `index`: chunk_id, document_id, chunk_sensitivity, sensitivity (the document's, for chunks
    without a level of their own: null or 0); `clearance`: user_id,
    max_clearance; `viewable` and `grants`: user_id, document_id. Everything is
    keyed by the few candidate rows, never by all users and documents.
    """
    keyed = (
        scored.join(queries.select("query_id", "user_id"), "query_id")
        .join(index, "chunk_id")
        .join(clearance.select("user_id", "max_clearance"), "user_id", "left")
        .join(viewable.select("user_id", "document_id", F.lit(True).alias("_view")),
              ["user_id", "document_id"], "left")
        .join(grants.select("user_id", "document_id", F.lit(True).alias("_grant")),
              ["user_id", "document_id"], "left")
    )
    level = F.coalesce("max_clearance", F.lit(1))
    own = F.coalesce(F.nullif("chunk_sensitivity", F.lit(0)), F.nullif("sensitivity", F.lit(0)), F.lit(1))
    above = own > level
    allowed, granted = F.col("_view").isNotNull(), F.col("_grant").isNotNull()
    flagged = keyed.where(allowed | ~above).withColumn(
        "chunk_blurred", allowed & above & ~granted
    )
    document = Window.partitionBy("query_id", "document_id")
    return flagged.withColumn(
        "doc_restricted", ~allowed | F.max("chunk_blurred").over(document)
    ).drop("_view", "_grant", "max_clearance")


def overlaps_nodes(rows: DataFrame, nodes: Column) -> DataFrame:
    """Keep rows whose node list shares a node with the requested ones."""
    return rows.where(F.arrays_overlap(F.col("oui_ids"), nodes))
