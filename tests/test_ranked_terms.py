"""Keyword scores are made where the counts of a chunk lie."""

import random

import pytest

from sievegate.operators import retrieval as rt


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(draw.randrange(9))) for _ in range(120)]
    rows = [(None if i % 40 == 7 else i % 90, None if i % 33 == 5 else t) for i, t in enumerate([*texts, *["ab cd"] * 30])]
    asked = [(1, "ab cd ef"), (1, "ab"), (2, "zz"), (3, None), (4, "kl kl gh")]
    return (spark.createDataFrame(rows, "chunk_id long, chunk_text string").repartition(5),
            spark.createDataFrame(asked, "query_id long, text string"))


def test_keyword_scores_of_repeated_ids_over_batches(spark, monkeypatch):
    """Rows of one id, and of none, count together, wherever the batches end."""
    def found(**more):
        return {(r["query_id"], r["chunk_id"]): r["raw_score"] for r in rt.bm25_scores(*corpus(spark), **more).collect()}

    with monkeypatch.context() as m:
        m.setattr(rt, "QUERY_TERMS_BROADCAST", 0)
        want = found()
        best = rt.bm25_top(*corpus(spark), k=4).orderBy("query_id", "rank").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = found()
        monkeypatch.setattr(rt, "SCORED_TERMS", 7)
        again, cut = found(), found(k=4)
        top = rt.bm25_top(*corpus(spark), k=4).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want and got == again == pytest.approx(want) and cut.items() <= got.items()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in top] == [(r["query_id"], r["chunk_id"], r["rank"]) for r in best]


def test_no_pair_of_chunk_and_query_is_shuffled(spark):
    text = plan(rt.bm25_scores(*corpus(spark)))
    assert "HashAggregate" not in text and "SortAggregate" not in text and "SortMergeJoin" not in text
