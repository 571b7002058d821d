"""Encoder hook, ingest run and mail sync: batches that run again, blanks, and a lost index."""

from pyspark.sql import functions as F

from sievegate.operators import retrieval as rt
from sievegate.operators.chunking import ChunkSettings
from sievegate.session import shared_dir
from sievegate.sources.sinks import replace_partitions
from sievegate.streaming import ingest as ig
from sievegate.streaming.mail_sync import sync_once


def test_encoder_sees_batches_without_blanks(spark):
    def make():
        calls = []

        def encode(texts):
            assert 0 < len(texts) <= 3 and all(t == t.strip() and t for t in texts)
            calls.append(1)
            return [[float(len(t)), float(len(calls))] for t in texts]

        return encode

    texts = ["a", " bb ", None, "", "ccc", " \n", "dddd", "ee", "f"]
    frame = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "id long, text string, encode_ms double").coalesce(1)
    rows = sorted(rt.encode_texts(frame, make, batch=3).collect())
    assert [len(r["embedding"]) for r in rows] == [2 if (t or "").strip() else 0 for t in texts]
    assert [r["embedding"][0] for r in rows if r["embedding"]] == [1, 2, 3, 4, 2, 1]
    # One encoder for the whole task: its calls go on counting.
    assert [r["embedding"][1] for r in rows if r["embedding"]] == [1, 1, 1, 2, 2, 2]
    assert all((r["encode_ms"] > 0) == bool(r["embedding"]) for r in rows)


def test_ingest_run_replaces_its_own_batch(spark, tmp_path):
    out = f"{tmp_path}/run"
    shared_dir(spark)
    versions = spark.createDataFrame(
        [(1, 1, "a.txt", "", b"Some words here. And more."), (2, 1, "b.pdf", "", b"%PDF"), (3, 2, "c.md", "", b" \n "),
         (4, 1, "d", "", b"Broken \xff\xfe bytes stay out."), (5, 1, "e.png", None, None)],
        "doc_id long, version_no int, name string, mime string, content binary")
    for batch, rows in ((1, versions), (2, versions.where("doc_id = 1")), (1, versions.where("doc_id <> 4"))):
        steps = {r["step"]: r for r in ig.ingest_run(rows, out, batch, ChunkSettings(), rt.hashed_encoder(8)).collect()}
        assert set(steps) == {"parse", "chunk", "embed", "index", "reject"} and steps["index"]["duration_ms"] > 0
    index = spark.read.parquet(f"{out}/index")
    assert sorted((r["batch_id"], r["doc_id"]) for r in index.collect()) == [(1, 1), (2, 1)]
    assert {len(r["embedding"]) for r in index.collect()} == {8}
    rejects = {(r["batch_id"], r["doc_id"], r["reason"]) for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert rejects == {(1, 2, "needs_reader"), (1, 3, "no_text"), (1, 5, "needs_reader")}
    figures = {(r["batch_id"], r["step"]): r["n_rows"] for r in spark.read.parquet(f"{out}/steps").collect()}
    assert figures[1, "parse"] == 2 and figures[1, "index"] == 1 and figures[1, "reject"] == 3 and figures[2, "index"] == 1


def test_contents_are_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: read.add(1) or x, "binary").asNondeterministic()
    rows = spark.range(40).selectExpr("id doc_id", "1 version_no", "concat(id, '.txt') name", "'' mime", "encode(concat('Words of ', id, '.'), 'utf-8') raw")
    ig.ingest_run(rows.withColumn("content", counted("raw")).drop("raw"), f"{tmp_path}/once", 0, ChunkSettings(), rt.hashed_encoder(8))
    assert read.value == 40


def test_mail_sync_runs_again_and_fills_a_lost_index(spark, tmp_path):
    index, ledger, counts = (f"{tmp_path}/{n}" for n in ("index", "ledger", "counts"))
    listing = lambda ids: spark.createDataFrame(
        [(i % 2, i, f"s{i}", f"text {i}") for i in ids] + [(0, 99, "blank", "")], "user_id long, message_id long, subject string, text string")
    write = sync_once(index, ledger, counts)
    seen = lambda b: {r["user_id"]: (r["synced"], r["skipped"]) for r in spark.read.parquet(counts).where(f"batch_id = {b}").collect()}
    write(listing([1, 2, 3, 3]), 0)
    assert seen(0) == {0: (1, 0), 1: (2, 0)}
    write(listing([1, 2, 3, 4, 5]), 1)
    write(listing([1, 2, 3, 4, 5]), 1)  # the same batch again
    assert seen(1) == {0: (1, 1), 1: (1, 2)}
    assert sorted(r["message_id"] for r in spark.read.parquet(index).collect()) == [1, 2, 3, 4, 5]
    again = sync_once(f"{tmp_path}/index2", ledger, counts)
    again(listing([1, 2]), 2)
    assert seen(2) == {0: (1, 0), 1: (1, 0)}
    again(listing([2]), 3)
    assert seen(3) == {0: (0, 1)}


def test_ledger_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    rows = ig.bucketed(spark.range(2000).selectExpr("cast(id as string) ingest_key", "0L batch_id"), "ingest_key")
    replace_partitions(rows, path, ["bucket", "batch_id"])
    few = ig.bucketed(spark.createDataFrame([("5",), ("17",)], "ingest_key string"), "ingest_key")
    part = ig.touched(ig.stored(spark, path, ""), few)
    assert {r["ingest_key"] for r in part.collect()} >= {"5", "17"} and part.count() < 200
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1]
