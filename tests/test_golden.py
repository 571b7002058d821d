"""Small cases with answers worked out by hand or by brute force."""

import math
import random

from pyspark.sql import functions as F

from sievegate.functions import scoring as sc
from sievegate.functions import text as tx
from sievegate.operators import access as ac
from sievegate.operators import chunking as ch
from sievegate.operators import conversation as cv
from sievegate.operators import detection as dt
from sievegate.operators import policy as po
from sievegate.operators import retrieval as rt


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def column(df, expr):
    return df.select(expr.alias("x")).first()["x"]


# ---- text ---------------------------------------------------------------------

def test_normalize_text(spark):
    raw = "Ｆｕｌｌ​ width\r\nhy-\nphen\r- item\n\n\n\n* star\n**bold**  x \t y "
    assert column(one(spark, t=raw), tx.normalize_text("t")) == "Full width\nhyphen\nitem\n\nstar\n**bold** x y"


def test_headings(spark):
    cases = {
        "Chương 2: Quy định": (True, True), "Điều 5. Phạm vi": (True, True), "3. Tổng quan chung": (True, True),
        "TRÌNH CHUNG": (True, True), "hello world": (True, False), "**Section 1. Intro**": (True, True),
        "Chương 2: Quy định của": (False, False), "Mã tài liệu 1. X": (False, False), "": (False, False),
        "x" * 121: (False, False),
    }
    for line, (compat, strict) in cases.items():
        df = one(spark, t=line)
        assert column(df, tx.is_heading(F.col("t"), "compat")) is compat, line
        assert column(df, tx.is_heading(F.col("t"), "strict")) is strict, line


def test_markers_and_small_rules(spark):
    df = one(spark, t="a [3] b [1] [3] [12]")
    assert column(df, tx.cited_numbers("t")) == [1, 3, 12]
    assert column(df, tx.renumber_citations("t", tx.cited_numbers("t"))) == "a [2] b [1] [2] [3]"
    assert column(one(spark, t="  hi \n"), tx.markdown_wrap("t", F.lit("**"))) == "  **hi** \n"
    assert column(one(spark, t="Điện thoại"), tx.strip_accents("t")) == "Dien thoai"
    assert column(one(spark, t="I CANNOT answer that"), tx.is_no_answer("t")) is True


# ---- chunks --------------------------------------------------------------------

def test_packing_by_example(spark):
    """Sentences of 5, 5, 5 and 30 words; at most 12 in a chunk, at most 5 of overlap."""
    sents = [" ".join(f"s{i}w{j}" for j in range(n - 1)) + f" end{i}." for i, n in enumerate((5, 5, 5, 30))]
    rows = ch.chunk_documents(one(spark, doc_id=1, text=" ".join(sents)), ch.ChunkSettings(12, 5, 0, "strict"))
    long = sents[3].split()
    assert [r["chunk_text"] for r in rows.orderBy("chunk_index").collect()] == [
        " ".join(sents[0:2]), " ".join(sents[1:3]), " ".join(long[0:12]), " ".join(long[7:19]),
        " ".join(long[14:26]), " ".join(long[21:30])]


def test_packing_keeps_what_it_promises(spark):
    """Nothing lost, order kept, overlap within its bound; a chunk is over its size by the overlap at most."""
    rng = random.Random(7)
    texts = []
    for case in range(30):
        counts = [rng.choice([1, 2, 3, 5, 8, 30]) for _ in range(rng.randint(1, 25))]
        texts.append((case, " ".join(
            " ".join([*(f"w{case}x{i}y{j}" for j in range(n - 1)), f"e{i}."]) for i, n in enumerate(counts))))
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    rows = ch.chunk_documents(docs, ch.ChunkSettings(12, 5, 0, "strict")).orderBy("doc_id", "chunk_index").collect()
    for case, text in texts:
        chunks = [r["chunk_text"].split() for r in rows if r["doc_id"] == case]
        assert all(0 < len(c) <= 12 + 5 for c in chunks)
        joined = list(chunks[0])
        for last, chunk in zip(chunks, chunks[1:]):
            shared = max(k for k in range(6) if k == 0 or last[-k:] == chunk[:k])
            joined += chunk[shared:]
        assert joined == text.split()


def test_small_piece_joins_and_keeps_hash(spark):
    docs = one(spark, doc_id=1, text="Alpha beta gamma delta.\nSECTION ONE\nTiny.")
    rows = ch.chunk_documents(docs, ch.ChunkSettings(50, 0, 3, "strict")).collect()
    assert len(rows) == 1 and rows[0]["chunk_text"] == "Alpha beta gamma delta.\n\nTiny."
    assert rows[0]["chunk_hash"] == column(docs, F.sha2(F.lit("Alpha beta gamma delta."), 256))
    assert rows[0]["token_count"] == 5


def test_page_location(spark):
    pages = spark.createDataFrame([(1, 1, "first page has text here"), (1, 2, "second page holds more text")], "doc_id int, page_no int, text string")
    chunks = spark.createDataFrame([(1, 0, "second page holds"), (1, 1, "not to be found anywhere")], "doc_id int, chunk_index int, chunk_text string")
    got = {r["chunk_index"]: (r["page_start"], r["page_end"]) for r in ch.locate_pages(chunks, pages).collect()}
    assert got == {0: (2, 2), 1: (1, 2)}


# ---- retrieval --------------------------------------------------------------------

def test_bm25_by_hand(spark):
    docs = {1: "apple apple pear", 2: "apple plum", 3: "apple fig fig", 4: "kiwi lime"}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id int, chunk_text string")
    queries = spark.createDataFrame([(0, "apple fig fig")], "query_id int, text string")
    tokens = {k: v.split() for k, v in docs.items()}
    n, avg = 4, sum(map(len, tokens.values())) / 4
    vocab = {t for ts in tokens.values() for t in ts}
    idf = {t: math.log(n - d + .5) - math.log(d + .5) for t in vocab for d in [sum(t in ts for ts in tokens.values())]}
    mean = sum(idf.values()) / len(idf)
    idf = {t: .25 * mean if v < 0 else v for t, v in idf.items()}
    assert math.log(1.5) - math.log(3.5) < 0 < idf["apple"]

    def score(ts):
        return sum(idf[q] * ts.count(q) * 2.5 / (ts.count(q) + 1.5 * (.25 + .75 * len(ts) / avg)) for q in ["apple", "fig", "fig"])

    got = {r["chunk_id"]: r["raw_score"] for r in rt.bm25_scores(chunks, queries).collect()}
    want = {k: score(ts) for k, ts in tokens.items() if score(ts) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_bm25_salted_path_equals_broadcast(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, "hot " * (i % 3 + 1) + f"t{i % 4}") for i in range(60)], "chunk_id int, chunk_text string")
    queries = spark.createDataFrame([(0, "hot t1"), (1, "t2 t3")], "query_id int, text string")

    def rows():
        return sorted(map(tuple, rt.bm25_scores(chunks, queries).collect()))

    small = rows()
    monkeypatch.setattr(rt, "QUERY_TERMS_BROADCAST", 1)
    assert rows() == small


def test_cosine_paths_and_copies(spark):
    rng = random.Random(3)
    vecs = [(i, [rng.random() for _ in range(4)]) for i in range(40)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)]
    vecs += [(500, [0.0, 0.0, 0.0, 0.0]), (501, [1.0])]
    queries = [(q, [1.0, 0.0, 0.0, 0.1 * q]) for q in range(5)]
    v = spark.createDataFrame(vecs, "chunk_id int, embedding array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>")

    def rows(block):
        return sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in rt.cosine_top(v, q, 6, block).collect())

    assert rows(100) == rows(2)
    # Equal copies are taken in id order.
    assert [c for qid, _, c in rows(100) if qid == 0] == [100, 101, 102, 103, 104, 105]


def test_fusion_and_display(spark):
    sem = spark.createDataFrame([(0, "a", 0, .1), (0, "b", 1, .2)], "query_id int, chunk_id string, rank int, distance double")
    lex = spark.createDataFrame([(0, "b", 0, 0., 5.), (0, "c", 1, .5, 2.)], "query_id int, chunk_id string, rank int, distance double, raw_score double")
    got = {r["chunk_id"]: r for r in rt.with_scores(rt.fuse(sem, lex)).collect()}
    assert got["b"]["rrf_score"] == round(1 / 62 + 1 / 61, 6) and got["b"]["sources"] == "lexical,semantic"
    assert got["a"]["rrf_score"] == round(1 / 61, 6) and got["c"]["rrf_score"] == round(1 / 62, 6)
    assert got["b"]["score"] == round(.6 * .8 + .4 / (1 + math.exp(-1)), 6)
    assert got["a"]["score"] == .9 and got["c"]["score"] == round(1 / (1 + math.exp(-.4)), 6)


def test_embedding_hook_keeps_blank_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "  "), (3, None), (4, "c")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in rt.embed_texts(rows, lambda ts: [[float(len(t))] for t in ts], batch=1).collect()}
    assert got == {1: [3.0], 2: [], 3: [], 4: [1.0]}


# ---- access ------------------------------------------------------------------------

def test_closure_with_cycle_and_two_parents(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("x", "y"), ("y", "x")], "oui_id string, parent_oui_id string")
    got = {tuple(r) for r in ac.closure(edges).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}


def test_effective_clearance_cases(spark):
    pairs = spark.createDataFrame([("n1", "r"), ("n2", "r"), ("r", "c"), ("n1", "c"), ("n2", "c")], "oui_id string, ancestor_id string")
    held = spark.createDataFrame([(1, "n1", 4), (2, "n1", 4), (2, "n2", 2), (3, "c", 3), (4, "z", 5)], "user_id int, oui_id string, clearance int")
    nodes = spark.createDataFrame([(10, "n1"), (11, "r")], "doc_id int, oui_id string")
    wanted = spark.createDataFrame([(1, 10), (2, 11), (3, 11), (4, 11), (2, 12)], "user_id int, doc_id int")
    got = {(r["user_id"], r["doc_id"]): r["effective_clearance"] for r in ac.effective_clearance(wanted, held, nodes, pairs).collect()}
    assert got == {(1, 10): 4, (2, 11): 2, (3, 11): 3, (4, 11): 1, (2, 12): 4}


def test_higher_clearance_never_sees_less(spark):
    edges = spark.createDataFrame([("n", "r"), ("r", "c")], "oui_id string, parent_oui_id string")
    nodes = spark.createDataFrame([("n",), ("r",), ("c",)], "oui_id string")
    pairs = ac.closure(edges)
    docs = spark.createDataFrame([(i, 99, 1 + i % 5) for i in range(10)], "doc_id int, owner_user_id int, sensitivity int")
    placed = spark.createDataFrame([(i, "nrc"[i % 3]) for i in range(10)], "doc_id int, oui_id string")
    tuples = ac.document_tuples(docs, placed, nodes, edges, pairs)
    held = spark.createDataFrame([(u, "r", u) for u in range(1, 6)], "user_id int, oui_id string, clearance int")
    clearance = held.selectExpr("user_id", "clearance max_clearance")
    seen = {}
    for r in ac.viewable_documents(held, tuples, held, pairs, clearance).collect():
        seen.setdefault(r["user_id"], set()).add(r["doc_id"])
    assert all(seen.get(u, set()) <= seen.get(u + 1, set()) for u in range(1, 5)) and seen[5]


# ---- governance ----------------------------------------------------------------------

def test_pii_spans_by_hand(spark):
    text = "Nguyễn Văn An, 091 345 678, 1.500.000 VND, 012345678901, a@b.vn"
    spans = column(one(spark, t=text), dt.pii_spans(F.col("t")))
    assert [(s["entity_type"], text[s["start"]:s["end"]]) for s in spans] == [
        ("PERSON_NAME", "Nguyễn Văn An"), ("PHONE_NUMBER", "091 345 678"), ("SALARY_AMOUNT", "1.500.000 VND"),
        ("CCCD_CMND", "012345678901"), ("EMAIL_ADDRESS", "a@b.vn")]
    clean = column(one(spark, t=text), dt.redact(F.col("t"), dt.pii_spans(F.col("t"))))
    assert clean == "[PERSON_NAME], [PHONE_NUMBER], [SALARY_AMOUNT], [CCCD_CMND], [EMAIL_ADDRESS]"
    again = column(one(spark, t=clean), dt.redact(F.col("t"), dt.pii_spans(F.col("t"))))
    assert again == clean


def test_anonymize_uses_one_alias_per_value(spark):
    text = "a@b.vn then c@d.vn then a@b.vn"
    got = column(one(spark, t=text), dt.anonymize(F.col("t"), dt.pii_spans(F.col("t"))))
    assert got == "[EMAIL_ADDRESS-1] then [EMAIL_ADDRESS-2] then [EMAIL_ADDRESS-1]"


def rules_of(spark, *rows):
    return spark.createDataFrame(
        [(1, c, a, p, False, d, n) for c, a, p, d, n in rows],
        "k int, rule_code string, action string, priority int, mandatory boolean, max_detail string, numeric_granularity string")


def test_deny_overrides(spark):
    cond = [("A", "conditional", 5, "summarize", "hidden"), ("B", "conditional", 9, "redact", "exact")]
    got = po.resolve_conflicts(rules_of(spark, *cond), "k").first()
    assert (got["decision"], got["max_detail"], got["numeric_granularity"], got["winning_rule"]) == ("conditional", "redact", "hidden", "B")
    block = po.resolve_conflicts(rules_of(spark, *cond, ("C", "block", 1, None, None)), "k").first()
    assert (block["decision"], block["winning_rule"], block["decision_reason"]) == ("block", "C", "block_overrides")
    mark = po.resolve_conflicts(rules_of(spark, ("W", "watermark", 1, None, None), ("O", "allow", 9, None, None)), "k").first()
    assert mark["decision"] == "watermark"


# ---- conversations ---------------------------------------------------------------------

def test_pairing(spark):
    rows = [("user", "q1", "success"), ("user", "q2", "success"), ("assistant", "a2", "success"), ("system", "s", "success"),
            ("user", "q3", "success"), ("assistant", "short", "streaming"), ("user", "q4", "success"), ("assistant", "long enough text", "streaming")]
    df = spark.createDataFrame([(f"m{i}", 1, r, c, s, None, i) for i, (r, c, s) in enumerate(rows)],
                               "message_id string, conv_id int, role string, content string, status string, parent_message_id string, created_s int")
    got = [(r["question"], r["answer"]) for r in cv.qa_pairs(df).orderBy("pair_no").collect()]
    assert got == [("q2", "a2"), ("q4", "long enough text")]


def test_citations_by_hand(spark):
    src = "array(named_struct('document_id', 'd1', 'restricted', true), named_struct('document_id', 'd1', 'restricted', true), named_struct('document_id', 'd2', 'restricted', false))"
    df = spark.sql(f"SELECT 1 answer_id, 'a [3] b [1] [3] [9]' answer, {src} sources UNION ALL SELECT 2, 'none', {src}")
    got = {r["answer_id"]: (r["answer"], [s["document_id"] for s in r["kept_sources"]]) for r in cv.normalize_citations(df).collect()}
    assert got == {1: ("a [2] b [1] [2] [3]", ["d1", "d2"]), 2: ("none", ["d1"])}


def test_level_names(spark):
    df = one(spark, t="Restricted")
    assert column(df, sc.level_rank("t")) == 3 and column(df, sc.level_rank(F.lit("odd"))) == 0


def test_vectors_of_other_lengths_score_zero(spark):
    """One odd vector on either side changes nothing for the others, in both paths."""
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [-1.0, 0.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    for block in (10, 1):
        rows = rt.cosine_top(vectors, queries, 4, block).collect()
        got = {(r["query_id"], r["chunk_id"]): r["similarity"] for r in rows}
        assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): 0.0, (1, 4): -1.0,
                       (2, 3): 1.0, (2, 1): 0.0, (2, 2): 0.0, (2, 4): 0.0}


def test_gate_falls_back_to_the_level_of_the_document(spark):
    scored = spark.createDataFrame([(1, c, 1.0) for c in (1, 2, 3, 4)], "query_id long, chunk_id long, rrf_score double")
    index = spark.createDataFrame(
        [(1, 10, None, 5), (2, 20, 0, 5), (3, 30, None, None), (4, 40, 2, 1)],
        "chunk_id long, document_id long, chunk_sensitivity int, sensitivity int")
    queries = spark.createDataFrame([(1, 7)], "query_id long, user_id long")
    levels = spark.createDataFrame([(7, 1)], "user_id long, max_clearance int")
    none = spark.createDataFrame([], "user_id long, document_id long")
    rows = rt.gate_results(scored, index, queries, levels, none, none).collect()
    assert [r["chunk_id"] for r in rows] == [3]
