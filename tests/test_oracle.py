"""Registered queries against their SQL on the smallest tables.

`python tests/check.py` runs all of them at any scale; this is a cross-section.
"""

import re

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CROSS_SECTION = """
text_normalize html_to_text repeated_page_lines document_sections packed_chunks merged_sections
external_chunk_lists table_markdown semantic_top semantic_top_grid bm25_top token_f1_top hybrid_search
gated_search org_closure document_tuples viewable_documents view_edit_flags effective_clearance
access_status request_workflow review_transitions pii_spans pii_redaction structured_entities
boolean_labels domain_scores conflict_resolution policy_contracts qa_pairs chat_history citations
flat_messages upsert_latest cascade_delete mail_documents parsed_files clean_rerun stream_jobs
""".split()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_equals_sql(spark, con, name):
    assert oracle.compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    # Queries of the optional training-data operators have tests of their own.
    names = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert names <= set(entry.oracle_sql()) and len(names) >= 157


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "chunk_id", "rank", "score"} <= set(rows[0].asDict())
