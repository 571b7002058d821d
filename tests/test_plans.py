"""What the plans must not contain, and what the scans must read."""

import pathlib
import re

import __spark_entry__ as entry
import pytest

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "packed_chunks", "bm25_top", "rank_fusion", "viewable_documents", "view_edit_flags", "domain_scores",
    "rule_candidates", "effective_clearance", "chat_history", "job_visibility", "request_listing"])
def test_no_pair_products(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_chunking_does_not_shuffle_after_the_scan(spark):
    from sievegate.operators.chunking import chunk_documents

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = plan(chunk_documents(docs))
    assert "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filters_reach_the_scan(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en'").select("doc_id")
    assert re.search(r"PushedFilters: \[.*EqualTo\(lang,en\)", plan(docs))


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(entry.queries()["bm25_top"](spark, FOLDER))
    assert "WindowGroupLimit" in text


def test_library_keeps_rows_off_the_driver():
    root = pathlib.Path(__file__).parent.parent / "sievegate"
    allowed = {("common.py", "rows = df.limit(limit + 1).collect()")}
    for path in root.rglob("*.py"):
        if path.parent.name == "llm":
            continue  # has bounded collects of its own, listed in its tests
        body = path.read_text()
        assert "crossJoin" not in body and "localCheckpoint" not in body and ".toPandas(" not in body
        for line in body.splitlines():
            if ".collect()" in line and (path.name, line.strip()) not in allowed:
                assert "at most one block" in line, (path.name, line)


def test_many_rules_meet_contexts_in_salted_parts(spark, monkeypatch):
    from sievegate.operators import policy

    query = entry.queries()["rule_candidates"]
    few = sorted(tuple(r) for r in query(spark, FOLDER).collect())
    monkeypatch.setattr(policy, "RULES_BROADCAST", 0)
    assert sorted(tuple(r) for r in query(spark, FOLDER).collect()) == few
