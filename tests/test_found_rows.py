"""Texts and registry rows of search results: the few found keys go to the rows, not the rows to the keys."""

import pytest

from sievegate.operators import common, conversation as cv
from sievegate.plans import dialogue
from sievegate.session import shared_dir


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def results(spark):
    texts = [(None, "none"), *[(i % 40, f"text {i}") for i in range(60)]]
    found = [(1, 3, 0), (1, 25, 1), (2, 3, 0), (2, 999, 1), (3, None, 0)]
    return (spark.createDataFrame(texts, "chunk_id long, chunk_text string"),
            spark.createDataFrame(found, "query_id long, chunk_id long, rank int"))


@pytest.mark.parametrize("few", [200_000, 0])
def test_rows_of_keeps_every_row_of_a_key(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_KEYS", few)
    chunks, found = results(spark)
    shared_dir(spark)
    rows = common.rows_of(chunks, found.checkpoint(), "chunk_id").collect()
    assert sorted(map(tuple, rows)) == [(3, "text 3"), (3, "text 43"), (25, "text 25")]


def test_only_texts_of_results_are_shuffled(spark, monkeypatch):
    chunks, found = results(spark)
    monkeypatch.setattr(dialogue, "search_parts", lambda *_: (chunks, None, None, None))
    monkeypatch.setattr(dialogue.rt, "search", lambda *_: found)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = dialogue.retrieved(spark, "")
        text = plan(got)
        rows = sorted((r["query_id"], r["chunk_id"], r["document_text"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows == [(q, c, f"text {t}") for q, c, t in [(1, 3, 3), (1, 3, 43), (1, 25, 25), (2, 3, 3), (2, 3, 43)]]
    sides = text[text.index("SortMergeJoin"):]
    assert "LeftSemi" in sides and sides.index("LeftSemi") > sides.index("Exchange") and "BroadcastHashJoin" in sides
    assert {r["query_id"]: r["n_sources"] for r in cv.excerpt_answers(got).collect()} == {1: 3, 2: 2}
