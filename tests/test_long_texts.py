"""Packing and page location of very long texts, and their walk against a plain definition."""

import time

import numpy as np
import pytest

from sievegate.operators import chunking as ch


def spans_by_definition(sections, counts, top, lap):
    """The rule spelled out: the next piece takes over as many of the last sentences as fit the overlap."""
    out, start, used = [], 0, 0
    for i, size in enumerate(counts):
        if i and sections[i] != sections[i - 1]:
            if start < i:
                out.append((start, i - 1))
            start, used = i, 0
        if size > top:
            out += [(start, i - 1)] * (start < i) + [(i, -1)]
            start, used = i + 1, 0
        elif start < i and used + size > top:
            out.append((start, i - 1))
            tail = [j for j in range(start, i) if sum(counts[j:i]) <= lap]
            start, used = (tail[0] if tail else i), sum(counts[tail[0]:i]) + size if tail else size
        else:
            used += size
    return out + [(start, len(counts) - 1)] * (start < len(counts))


def test_spans():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        counts = [int(c) for c in rng.integers(0, 16, n)]
        sections = sorted(int(c) for c in rng.integers(0, 3, n))
        prefix = [0, *np.cumsum(counts).tolist()]
        assert ch.sentence_spans(sections, prefix, 12, 5) == spans_by_definition(sections, counts, 12, 5)


def test_first_places():
    text = "abc abcd xabcd bcd " * 50 + "tail of the text"
    probes = {text[i:i + k] for i in range(0, 40, 3) for k in (3, 7, 11)} | {"nowhere", "tail of"}
    assert ch.first_places(text, probes) == {p: text.find(p) for p in probes if p in text}


@pytest.mark.parametrize("paged", [False, True])
def test_time_grows_with_the_length(spark, paged):
    """Four times the sentences take about four times as long: 16 times would be a quadratic walk."""
    def seconds(n):
        lines = [f"Sentence number {i} of a long text goes on for some words." for i in range(n)]
        pages = [(p + 1, "\n".join(lines[p * 50:(p + 1) * 50])) for p in range(n // 50)]
        frame = spark.createDataFrame(
            [(1, "\n".join(lines), pages)], "doc_id long, text string, pages array<struct<page_no:int,text:string>>")
        began = time.time()
        rows = ch.chunk_documents(frame, pages_col="pages" if paged else None).selectExpr(
            "count(*) n", "sum(token_count) tokens", "max(page_end) pages", "count_if(page_start <= page_end) right").first()
        assert rows["tokens"] >= 11 * n and rows["right"] == rows["n"]
        assert rows["pages"] == (n // 50 if paged else 1)
        return time.time() - began

    seconds(1000)
    short, long = min(seconds(50_000) for _ in range(2)), seconds(200_000)
    assert long < 8 * short + 1, (short, long)


def test_no_text_is_shuffled_for_pages(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, pages array<struct<page_no:int,text:string>>")
    plan = ch.chunk_documents(frame, pages_col="pages")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
