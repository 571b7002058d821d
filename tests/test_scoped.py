"""Scoped search against plain search over filtered chunks, and its paths for many queries and terms."""

import oracle
import pytest

import __spark_entry__ as entry
from sievegate.operators import retrieval as rt
from sievegate.operators import scoped as scp
from sievegate.plans import search

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("name", ["scoped_search", "collection_switch"])
def test_equals_sql(spark, name):
    con = oracle.connect(FOLDER)
    assert oracle.compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def small(spark):
    """Two classes, three cells, five users; user 3 has no position, user 4 owns out of reach, user 9 owns nothing."""
    texts = ["alpha beta gamma", "alpha alpha delta", "beta delta delta delta", "alpha omega", "gamma gamma beta", None, "",
             "alpha omega omega zeta", "beta", "alpha gamma zeta"]
    chunks = spark.createDataFrame(
        [(i, f"c{i % 3}", [3, 4, 1, None][i % 4], t, [float(i), 1.0, 3.0 - i]) for i, t in enumerate(texts)],
        "chunk_id long, cell string, owner_user_id long, chunk_text string, embedding array<double>")
    queries = spark.createDataFrame(
        [(i, u, t, [1.0, float(i), 0.5]) for i, (u, t) in enumerate(
            [(1, "alpha beta"), (2, "alpha zeta nowhere"), (3, "gamma omega"), (4, "delta alpha alpha"), (9, "beta"), (1, "")])],
        "query_id long, user_id long, text string, embedding array<double>")
    persons = spark.createDataFrame([(1, "a"), (2, "a"), (3, "none"), (4, "b"), (9, "b")], "user_id long, class_id string")
    scopes = spark.createDataFrame([("a", "c0"), ("a", "c1"), ("b", "c2"), ("b", "c0")], "class_id string, cell string")
    return chunks, queries, persons, scopes


def reach_of(chunks, persons, scopes, user):
    """The user's chunks spelled out as one filter."""
    name = persons.where(f"user_id = {user}").first()["class_id"]
    cells = [r["cell"] for r in scopes.where(f"class_id = '{name}'").collect()]
    inside = ", ".join(f"'{c}'" for c in cells) or "''"
    return chunks.where(f"cell IN ({inside}) OR owner_user_id = {user}")


def test_each_user_searches_a_corpus_of_their_own(small):
    chunks, queries, persons, scopes = small
    got = rows(scp.scoped_bm25(chunks, queries, persons, scopes))
    near = rows(scp.scoped_cosine(chunks, queries, persons, scopes, k=4).select("query_id", "chunk_id", "similarity"))
    want, want_near = [], []
    for user in (1, 2, 3, 4, 9):
        corpus, asked = reach_of(chunks, persons, scopes, user), queries.where(f"user_id = {user}")
        want += rows(rt.bm25_scores(corpus, asked).select("query_id", "chunk_id", "raw_score"))
        want_near += rows(rt.cosine_top(corpus, asked, 4).select("query_id", "chunk_id", "similarity"))
    assert got == sorted(want) and len({q for q, *_ in got}) == 4
    assert near == sorted(want_near)


def test_many_queries_and_terms_give_the_same(small, monkeypatch):
    chunks, queries, persons, scopes = small
    scores, near = rows(scp.scoped_bm25(chunks, queries, persons, scopes)), rows(scp.scoped_cosine(chunks, queries, persons, scopes))
    assert rows(scp.scoped_cosine(chunks, queries, persons, scopes, block=1)) == near
    monkeypatch.setattr(scp, "MATRIX", 6)  # blocks of two tokens
    assert rows(scp.scoped_bm25(chunks, queries, persons, scopes)) == scores
    monkeypatch.setattr(scp, "TERMS_BROADCAST", 0)
    monkeypatch.setattr(scp, "SCOPE_PAIRS", 3)
    assert rows(scp.scoped_bm25(chunks, queries, persons, scopes)) == scores
    assert rows(scp.scoped_cosine(chunks, queries, persons, scopes)) == near


def test_empty_inputs(small):
    chunks, queries, persons, scopes = small
    assert not rows(scp.scoped_bm25(chunks.limit(0), queries, persons, scopes))
    assert not rows(scp.scoped_bm25(chunks, queries.limit(0), persons, scopes))
    assert not rows(scp.scoped_cosine(chunks, queries.limit(0), persons, scopes))
    assert not rows(scp.scoped_cosine(chunks.limit(0), queries, persons, scopes))


def test_listing_counts_every_document_once(small):
    chunks, _, persons, scopes = small
    docs = chunks.selectExpr("chunk_id doc_id", "cell", "owner_user_id")
    got = {r["user_id"]: (r["n_documents"], r["id_sum"]) for r in scp.scope_listing(docs, persons, scopes).collect()}
    for user in (1, 2, 3, 4, 9):
        ids = [r["doc_id"] for r in reach_of(docs, persons, scopes, user).collect()]
        assert got[user] == (len(ids), sum(ids))


def test_out_of_scope_tokens_never_meet_a_query(spark):
    """Texts are not shuffled, and tokens meet terms on (token, cell)."""
    persons, scopes = search.scope_tables(spark, FOLDER)
    chunks, _, queries, _ = search.scoped_parts(spark, FOLDER)
    plan = scp.scoped_bm25(chunks, queries, persons, scopes)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "chunk_text" in line]
