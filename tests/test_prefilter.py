"""The longest token as a prefilter: resolved on distinct words, texts read twice for any number of queries."""

from pyspark.sql import functions as F

from sievegate.operators import retrieval as rt
from sievegate.session import shared_dir

TEXTS = ["the Reindeer runs", "reindeers run and rest", "a deer", "no such word", "xx yx xy", "Đèn đỏ sáng", "den do sang", None, "",
         "over-reindeer-ing\tand more", "REINDEER"]
ASKED = ["find reindeer", "deer", "xy", "đèn sáng", "unicorns and rest", "no", "", "and", "the the runs"]


def chunks_of(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, chunk_text string")


def test_parts_of_words(spark):
    shared_dir(spark)
    words = ["reindeer", "deer", "xy", "yx", "xx", "ab", "abab", "ababa", "é漢字ab", "aa"]
    parts = ["deer", "xy", "ab", "aba", "bab", "漢字", "zz", "abc", "xxx", "dee", "aab"]
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = {tuple(r) for r in rt.containing_words(frame(words, "word"), frame(parts, "main")).collect()}
    assert got == {(p, w) for p in parts for w in words if p in w}


def test_scores_against_every_pair(spark):
    """Every (query, chunk) pair spelled out; queries whose token is in no text go over all texts."""
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")
    chunks = chunks_of(spark)
    got = {(r["query_id"], r["chunk_id"]): round(r["f1"], 9) for r in rt.token_f1_top(chunks, queries, k=20).collect()}
    from sievegate.functions import text as tx
    bag = lambda c: F.array_distinct(F.transform(tx.search_tokens(c), tx.strip_accents))
    asked = queries.select("query_id", bag("text").alias("q"), tx.longest_token(tx.drop_stopwords(tx.search_tokens("text"))).alias("main"))
    held = chunks.select("chunk_id", "chunk_text", bag("chunk_text").alias("t"))
    want = {}
    texts = held.collect()
    for q in asked.where(F.size("q") > 0).collect():
        anywhere = any(q["main"] in (c["chunk_text"] or "") for c in texts)
        for c in texts:
            both = len(set(q["q"]) & set(c["t"] or []))
            if both and (q["main"] in c["chunk_text"] or not anywhere):
                p, r = both / len(c["t"]), both / len(q["q"])
                want[q["query_id"], c["chunk_id"]] = round(2 * p * r / max(1e-9, p + r), 9)
    assert got == want and len({q for q, _ in want}) >= 5


def test_scans_do_not_grow_with_the_queries(spark, tmp_path):
    """A counter in the scan: each text is read twice, by 3 queries as by 1,500."""
    chunks_of(spark).repartition(2).write.parquet(f"{tmp_path}/chunks")
    for n in (3, 1500):
        read = spark.sparkContext.accumulator(0)
        counted = F.udf(lambda x, read=read: read.add(1) or x, "string").asNondeterministic()
        chunks = spark.read.parquet(f"{tmp_path}/chunks").select("chunk_id", counted("chunk_text").alias("chunk_text"))
        queries = spark.createDataFrame([(i, f"word{i} reindeer") for i in range(n)], "query_id long, text string")
        rt.token_f1_top(chunks, queries).collect()
        assert 0 < read.value <= 2 * len(TEXTS) + 4, read.value
