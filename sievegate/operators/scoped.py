"""Search inside scopes: every query sees, counts and scores only the chunks in its user's reach.

Chunks: chunk_id, cell, owner_user_id, chunk_text. Chunks that the organisation's rules cannot tell apart
share a cell; a scope is a set of cells, shared by all users whom the rules cannot tell apart (a class),
and a user's own chunks come on top. So statistics are of a few classes and cells, not of users and chunks.

Scopes: class_id, cell. Persons: user_id, class_id. Queries: query_id, user_id, text or embedding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegate.functions import fixed_values as fixed
from sievegate.functions import text as tx
from sievegate.operators import access as ac
from sievegate.operators import retrieval as rt
from sievegate.operators.common import salted_join, small_rows, top_k, unnest
from sievegate.operators.retrieval import _best_of_block as best_of_block
from sievegate.operators.retrieval import _by_length as vectors_by_length
from sievegate.session import shared_dir

TERMS_BROADCAST = 500_000     # rows of (query, token, cell)
SCOPE_PAIRS = 2_000_000       # rows of (class, cell) that one pass over vectors sends along


# ---- who reaches what -----------------------------------------------------------------

def cell_key(nodes: Column | str, sensitivity: Column | str) -> Column:
    """The cell of a chunk: level and sorted nodes of its document, from the metadata on its own row."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes
    level = F.coalesce(F.col(sensitivity) if isinstance(sensitivity, str) else sensitivity, F.lit(1))
    return F.concat_ws("|", level.cast("string"), F.array_join(F.array_sort(F.array_distinct(nodes)), ","))


def person_classes(users: DataFrame, held: DataFrame, clearance: DataFrame) -> DataFrame:
    """user_id, class_id: users with the same nodes and level see the same documents but for their own."""
    asking = users.select("user_id").distinct()
    nodes = held.join(asking, "user_id", "left_semi").groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set("oui_id")), ",").alias("nodes"))
    level = F.coalesce("max_clearance", F.lit(1)).cast("string")
    return asking.join(nodes, "user_id", "left").join(
        clearance.select("user_id", "max_clearance"), "user_id", "left").select(
        "user_id", F.concat_ws("|", level, F.coalesce("nodes", F.lit(""))).alias("class_id"))


def class_scopes(
    persons: DataFrame, cells: DataFrame, held: DataFrame, nodes: DataFrame, edges: DataFrame, pairs: DataFrame,
    clearance: DataFrame,
) -> DataFrame:
    """class_id, cell: what a class may view, and all of its branch, over `cells` (cell, oui_ids, sensitivity).

    One user stands for a class and each cell for its documents, so the rules are evaluated on a table of
    classes and cells, whatever the number of users and documents.
    """
    heads = persons.groupBy("class_id").agg(F.min("user_id").alias("user_id"))
    one = cells.groupBy("cell").agg(
        F.min_by("oui_ids", F.array_join("oui_ids", ",")).alias("oui_ids"), F.max("sensitivity").alias("sensitivity"))
    docs = one.select(F.col("cell").alias("doc_id"), "sensitivity", F.lit(None).cast("long").alias("owner_user_id"))
    places = one.select(F.col("cell").alias("doc_id"), F.explode(F.array_distinct("oui_ids")).alias("oui_id"))
    tuples = ac.document_tuples(docs, places, nodes, edges, pairs).where("relation <> 'owner'")
    own = held.join(heads.select("user_id"), "user_id", "left_semi")
    viewed = ac.viewable_documents(heads, tuples, own, pairs, clearance).select("user_id", "doc_id")
    branch = ac.branch_nodes(own, pairs).join(places, "oui_id").select("user_id", "doc_id")
    return viewed.unionByName(branch).distinct().join(heads, "user_id").select(
        "class_id", F.col("doc_id").alias("cell"))


def outside_class(rows: DataFrame, persons: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows owned by one of `persons` in a cell that the owner's class does not reach."""
    owned = rows.join(persons.withColumnRenamed("user_id", "owner_user_id"), "owner_user_id")
    return owned.join(scopes, ["class_id", "cell"], "left_anti")


def scope_listing(documents: DataFrame, persons: DataFrame, scopes: DataFrame) -> DataFrame:
    """user_id, n_documents, id_sum: documents (doc_id, cell, owner_user_id) in reach, summed by cell first."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")]
    by_cell = documents.groupBy("cell").agg(*sums)
    by_class = by_cell.join(scopes, "cell").groupBy("class_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    shared = persons.join(by_class, "class_id").select("user_id", "n", "ids")
    own = outside_class(documents.select("doc_id", "cell", "owner_user_id"), persons, scopes).groupBy(
        F.col("owner_user_id").alias("user_id")).agg(*sums)
    return shared.unionByName(own).groupBy("user_id").agg(
        F.sum("n").alias("n_documents"), F.sum("ids").alias("id_sum"))


# ---- keyword search ---------------------------------------------------------------------

def cell_vocabulary(chunks: DataFrame, key: str) -> DataFrame:
    """key, token, df, total: one pass over the texts, summed before the shuffle; token '' stands for the cell."""
    ready = chunks.select(key, tx.search_tokens("chunk_text").alias("_t"))
    tokens = F.concat(F.array_distinct("_t"), F.array(F.lit("")))
    rows = unnest(ready, [key, F.size("_t").alias("dl")], tokens, "token")
    return rows.groupBy(key, "token").agg(F.count_if(F.col("dl") > 0).alias("df"), F.sum("dl").alias("total"))


def raw_idf(n: Column | str, df: Column | str) -> Column:
    n, df = (F.col(c) if isinstance(c, str) else c for c in (n, df))
    return F.log(n - df + 0.5) - F.log(df + 0.5)


MATRIX = 4_000_000            # numbers of a block of tokens by cells


def class_frequencies(pairs: list[tuple[str, str]]):
    """Document frequencies of every class from those of the cells, token by token in blocks.

    Comes over rows sorted by token: (token, cell, df, total) of the cells, and (token, classes) of the
    classes somebody asks about. Gives df and total of the classes asked about, and of all others only
    how many tokens have which df, so that classes times tokens never become rows.
    """
    names = sorted({c for c, _ in pairs})
    cells = {cell: i for i, cell in enumerate(sorted({cell for _, cell in pairs}))}
    place = {c: i for i, c in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.zeros((len(cells), len(names)))
        for c, cell in pairs:
            member[cells[cell], place[c]] = 1
        block = max(1, MATRIX // max(1, len(cells)))
        bins: list[Counter] = [Counter() for _ in names]
        tokens: list[str] = []
        at, where, counts, asked, totals = [], [], [], {}, np.zeros(len(cells))

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["class_id", "token", "df", "total", "n"])

        def worked() -> pa.RecordBatch:
            dense = np.zeros((len(tokens), len(cells)))
            np.add.at(dense, (at, where), counts)
            df = dense @ member
            words = np.array([t != "" for t in tokens], dtype=bool)
            for c, bin_ in enumerate(bins):
                for value, n in zip(*np.unique(df[words, c], return_counts=True)):
                    bin_[int(value)] += int(n)
            of_corpus = totals @ member
            return rows([
                (c, tokens[t], int(df[t, place[c]]), int(of_corpus[place[c]]) if not tokens[t] else 0, None)
                for t, classes in asked.items() for c in classes if c in place and df[t, place[c]] > 0])

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("token", "cell", "df", "total", "classes"))
            for token, cell, df, total, classes in zip(*columns):
                if not tokens or tokens[-1] != token:
                    if len(tokens) >= block:
                        yield worked()
                        tokens, at, where, counts, asked = [], [], [], [], {}
                    tokens.append(token)
                if classes is not None:
                    asked[len(tokens) - 1] = classes
                elif cell in cells:
                    at.append(len(tokens) - 1)
                    where.append(cells[cell])
                    counts.append(df)
                    if not token:
                        totals[cells[cell]] = total
        if tokens:
            yield worked()
        yield rows([(c, None, df, 0, n) for c, bin_ in zip(names, bins) for df, n in bin_.items() if df])

    return run


class ScopeStatistics:
    """Statistics of every person's scope, from those of its class and of the person's own chunks.

    The mean idf needs every token of a scope. It depends on a token's df alone, so a class keeps
    a histogram of df, and a person's own chunks move their tokens from one bin to another: a person costs
    as many rows as there are different df, not as there are tokens. Where the pairs of class and cell
    can be sent along, frequencies of cells become those of classes as a product of matrices in the task
    that has the token; beyond `SCOPE_PAIRS` of them they are joined.
    """

    def __init__(self, chunks: DataFrame, own: DataFrame, persons: DataFrame, scopes: DataFrame, terms: DataFrame):
        self.persons = persons
        by_cell = cell_vocabulary(chunks, "cell")
        self.own = cell_vocabulary(own.withColumnRenamed("owner_user_id", "user_id"), "user_id").join(
            persons, "user_id").checkpoint()
        pairs = small_rows(scopes.select("class_id", "cell"), SCOPE_PAIRS)
        if pairs is None:
            self.shared = by_cell.join(scopes, "cell").groupBy("class_id", "token").agg(
                F.sum("df").alias("df"), F.sum("total").alias("total")).checkpoint()
            self.bins = self.shared.where("token <> ''").groupBy("class_id", "df").agg(F.count(F.lit(1)).alias("n"))
        else:
            asked = self.own.select("class_id", "token").unionByName(terms.join(persons, "user_id").select("class_id", "token")).unionByName(
                persons.select("class_id", F.lit("").alias("token"))).groupBy("token").agg(F.collect_set("class_id").alias("classes"))
            rows = by_cell.unionByName(asked, allowMissingColumns=True).select("token", "cell", "df", "total", "classes")
            found = rows.repartition("token").sortWithinPartitions("token").mapInArrow(
                class_frequencies([tuple(p) for p in pairs]), "class_id string, token string, df long, total long, n long").checkpoint()
            self.shared = found.where("token IS NOT NULL").select("class_id", "token", "df", "total")
            self.bins = found.where("token IS NULL").groupBy("class_id", "df").agg(F.sum("n").alias("n"))
        self.sizes = self._sizes().join(self._floors(), "user_id", "left").checkpoint()

    def _corpora(self) -> DataFrame:
        shared = self.persons.join(self.shared.where("token = ''"), "class_id").select("user_id", "df", "total")
        return shared.unionByName(self.own.where("token = ''").select("user_id", "df", "total"))

    def _sizes(self) -> DataFrame:
        return self._corpora().groupBy("user_id").agg(
            F.sum("df").alias("n_chunks"), (F.sum("total") / F.nullif(F.sum("df"), F.lit(0))).alias("avg_length"))

    def _floors(self) -> DataFrame:
        """user_id, floor: the share of the mean idf that stands in for a negative one."""
        whole = self.persons.join(self.bins, "class_id").select("user_id", "df", "n")
        moved = self.own.where("token <> ''").select("user_id", "class_id", "token", F.col("df").alias("more")).join(
            self.shared.select("class_id", "token", "df"), ["class_id", "token"], "left")
        gone = moved.where("df IS NOT NULL").select("user_id", "df", F.lit(-1).cast("long").alias("n"))
        came = moved.select("user_id", (F.coalesce("df", F.lit(0)) + F.col("more")).alias("df"), F.lit(1).cast("long").alias("n"))
        binned = whole.unionByName(gone).unionByName(came).groupBy("user_id", "df").agg(F.sum("n").alias("n")).where("n > 0")
        return binned.join(self._sizes().select("user_id", "n_chunks"), "user_id").groupBy("user_id").agg(
            (fixed.BM25_EPSILON * F.sum(F.col("n") * raw_idf("n_chunks", "df")) / F.sum("n")).alias("floor"))

    def weights(self, terms: DataFrame) -> DataFrame:
        """query_id, user_id, class_id, token, weight, avg_length of the query terms that the scope has."""
        known = terms.join(self.persons, "user_id").join(
            self.shared.select("class_id", "token", F.col("df").alias("df_shared")), ["class_id", "token"], "left").join(
            self.own.select("user_id", "token", F.col("df").alias("df_own")), ["user_id", "token"], "left")
        df = F.coalesce("df_shared", F.lit(0)) + F.coalesce("df_own", F.lit(0))
        raw = known.withColumn("df", df).where("df > 0").join(self.sizes, "user_id")
        idf = raw_idf("n_chunks", "df")
        return raw.select(
            "query_id", "user_id", "class_id", "token", "avg_length",
            (F.when(idf < 0, F.col("floor")).otherwise(idf) * F.col("times")).alias("weight"))


def _tokens(chunks: DataFrame, keep: list[str], wanted: DataFrame) -> DataFrame:
    """Counts of the wanted tokens of each chunk; no other token leaves its row's task."""
    ready = chunks.select("chunk_id", *keep, tx.search_tokens("chunk_text").alias("_t"))
    rows = unnest(ready, ["chunk_id", *keep, F.size("_t").alias("dl")], "_t", "token")
    few = wanted.limit(TERMS_BROADCAST + 1).count() <= TERMS_BROADCAST
    met = rows.join(F.broadcast(wanted) if few else wanted, "token", "left_semi")
    return met.groupBy("chunk_id", *keep, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def _meet(tokens: DataFrame, terms: DataFrame, on: list[str]) -> DataFrame:
    """Tokens and the terms of those who reach them; few terms go to every task, many meet in salted parts."""
    if terms.limit(TERMS_BROADCAST + 1).count() <= TERMS_BROADCAST:
        return tokens.join(F.broadcast(terms), on)
    return salted_join(tokens, terms, on, "chunk_id")


def scoped_bm25(chunks: DataFrame, queries: DataFrame, persons: DataFrame, scopes: DataFrame) -> DataFrame:
    """query_id, chunk_id, raw_score > 0 with the statistics of exactly each user's scope.

    Chunks out of a query's reach never become a pair with it: query terms are spread over the cells of
    their scope before they meet tokens, on (token, cell).
    """
    shared_dir(chunks.sparkSession)
    rows = chunks.select("chunk_id", "cell", "owner_user_id", "chunk_text")
    scopes = scopes.select("class_id", "cell").distinct().checkpoint()
    persons = persons.join(queries.select("user_id"), "user_id", "left_semi").checkpoint()
    own = outside_class(rows, persons, scopes).select("chunk_id", "owner_user_id", "chunk_text").checkpoint()
    asked = rt.query_terms(queries).join(queries.select("query_id", "user_id"), "query_id").checkpoint()
    terms = ScopeStatistics(rows, own, persons, scopes, asked).weights(asked).checkpoint()
    weighed = ["query_id", "token", "weight", "avg_length"]
    wanted = terms.select("token").distinct()
    spread = terms.join(scopes, "class_id").select(*weighed, "cell")
    shared_hits = _meet(_tokens(rows, ["cell"], wanted), spread, ["token", "cell"])
    own_hits = _meet(
        _tokens(own, ["owner_user_id"], wanted),
        terms.select(*weighed, F.col("user_id").alias("owner_user_id")), ["token", "owner_user_id"])
    columns = ["query_id", "chunk_id", "weight", "avg_length", "dl", "tf"]
    hits = shared_hits.select(columns).unionByName(own_hits.select(columns))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_length")))
    return hits.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(part), rt.SCORE_DIGITS).alias("raw_score")).where("raw_score > 0")


def ranked_bm25(scores: DataFrame, k: int = fixed.LEXICAL_CANDIDATES) -> DataFrame:
    """The k best per query with the distance relative to the best."""
    best = top_k(scores, ["query_id"], [F.col("raw_score").desc(), F.col("chunk_id").asc()], k)
    lead = F.max("raw_score").over(Window.partitionBy("query_id"))
    return best.select("query_id", "chunk_id", "rank", "raw_score",
                       F.greatest(F.lit(0.0), 1.0 - F.col("raw_score") / lead).alias("distance"))


# ---- vector search ------------------------------------------------------------------------

def _scan_scoped(asked: dict, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Local k best in scope per query over all batches of a task."""
    best: list[tuple] | None = None
    ids, users, places, reach, groups = (asked[n] for n in ("ids", "users", "classes", "reach", "groups"))
    for batch in batches:
        if batch.empty:
            continue
        codes, cells = pd.factorize(batch["cell"])
        seen = np.array([[cell in r for cell in cells] for r in reach], dtype=bool).reshape(len(reach), len(cells))
        allowed = seen[places][:, codes] | (users[:, None] == batch["owner_user_id"].fillna(-1).to_numpy()[None, :])
        sims = np.zeros((len(ids), len(batch)))
        for length, (at, rows) in vectors_by_length(batch["embedding"].to_numpy()).items():
            if length in groups:
                which, matrix = groups[length]
                sims[np.ix_(which, at)] = np.round(matrix @ rows.T, 12)
        chunk_ids = batch["chunk_id"].to_numpy()
        found = []
        for i in range(len(ids)):
            scores, names = sims[i][allowed[i]], chunk_ids[allowed[i]]
            if best is not None:
                scores, names = np.concatenate([best[i][0], scores]), np.concatenate([best[i][1], names])
            found.append(best_of_block(scores[None, :], names[None, :], k)[0])
        best = found
    if best is not None:
        yield pd.DataFrame({
            "query_id": np.repeat(ids, [len(s) for s, _ in best]),
            "chunk_id": np.concatenate([n for _, n in best]), "similarity": np.concatenate([s for s, _ in best])})


def scoped_cosine(
    vectors: DataFrame, queries: DataFrame, persons: DataFrame, scopes: DataFrame,
    k: int = fixed.SEMANTIC_CANDIDATES, block: int = rt.QUERY_VECTORS_BROADCAST,
) -> DataFrame:
    """Exact cosine top-k per query over the vectors (chunk_id, cell, owner_user_id, embedding) in its reach.

    A pass sends at most `block` query vectors and `SCOPE_PAIRS` pairs of class and cell to every task, which
    masks its vectors before it ranks them; more queries take more passes. Ids of users are numbers.
    """
    shared_dir(vectors.sparkSession)
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("similarity", T.DoubleType())])
    wanted = queries.select("query_id", "user_id", "embedding").where(F.size("embedding") > 0).join(
        persons, "user_id").checkpoint()
    n_cells = scopes.select("cell").distinct().count()
    block = max(1, min(block, SCOPE_PAIRS // max(1, n_cells)))
    blocks, context = 1, vectors.sparkSession.sparkContext
    part_of = lambda n: F.pmod(F.xxhash64("query_id"), F.lit(n))
    while not wanted.groupBy(part_of(blocks).alias("b")).count().where(F.col("count") > block).isEmpty():
        blocks *= 2
    slim = vectors.select("chunk_id", "cell", "owner_user_id", "embedding").where(F.size("embedding") > 0)
    local = None
    for number in range(blocks):
        part = wanted.where(part_of(blocks) == number)
        rows = part.collect()  # at most one block
        classes = sorted({r["class_id"] for r in rows})
        reach = {c: set() for c in classes}
        for r in scopes.join(part.select("class_id").distinct(), "class_id", "left_semi").collect():  # at most one block
            reach[r["class_id"]].add(r["cell"])
        sent = context.broadcast({
            "ids": np.array([r["query_id"] for r in rows]), "users": np.array([r["user_id"] for r in rows], dtype=np.int64),
            "classes": np.array([classes.index(r["class_id"]) for r in rows], dtype=np.int64),
            "reach": [reach[c] for c in classes], "groups": vectors_by_length([r["embedding"] for r in rows])})

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            yield from _scan_scoped(sent.value, k, batches)

        if rows:
            found = slim.mapInPandas(scan, schema)
            local = found if local is None else local.unionByName(found)
    if local is None:
        local = slim.sparkSession.createDataFrame([], schema)
    order = [F.col("similarity").desc(), F.col("chunk_id").asc()]
    return top_k(local, ["query_id"], order, k).select(
        "query_id", "chunk_id", "rank", "similarity", (1.0 - F.col("similarity")).alias("distance"))


def scoped_search(
    chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, persons: DataFrame,
    scopes: DataFrame, k: int = fixed.DEFAULT_TOP_K, candidates: int = fixed.SEMANTIC_CANDIDATES,
) -> DataFrame:
    """Hybrid search in which both lists come from the user's scope alone."""
    semantic = scoped_cosine(vectors, query_vectors, persons, scopes, candidates)
    lexical = ranked_bm25(scoped_bm25(chunks, queries, persons, scopes), candidates)
    scored = rt.with_scores(rt.fuse(semantic, lexical))
    return top_k(scored, ["query_id"], rt.fused_order(), min(k, fixed.SEARCH_CAP))


def collection_of_each(
    chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame,
    k: int = fixed.DEFAULT_TOP_K, candidates: int = fixed.SEMANTIC_CANDIDATES,
) -> DataFrame:
    """Hybrid search of each user in their own small collection: the owner is the cell and the class.

    Any number of collections is counted in one pass; statistics are keyed by (owner, token).
    """
    owner = F.col("owner_user_id").cast("string")
    persons = queries.select("user_id").distinct().withColumn("class_id", F.col("user_id").cast("string"))
    scopes = persons.select("class_id", F.col("class_id").alias("cell"))
    return scoped_search(
        chunks.withColumn("cell", owner), vectors.withColumn("cell", owner), queries, query_vectors, persons, scopes,
        k, candidates)
