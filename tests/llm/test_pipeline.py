"""The pipeline's stages against the operators' own brute-force results."""

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [r["doc_id"] for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema) if name != "shards" else (
            stage(spark, docs, FOLDER))
        now = [r["doc_id"] for r in docs.collect()]
        assert set(now) <= set(kept)
        if name != "shards":
            assert docs.columns == columns
        if name in ("toxicity", "near_duplicates", "benchmark"):
            assert len(now) == len(set(now)) < len(kept)
        kept = now
    shards = {r["doc_id"]: r["shard"] for r in docs.collect()}
    assert all(0 <= s < 24 for s in shards.values())


def test_run_equals_stages_and_itself(spark):
    one, two = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
                for _ in range(2))
    assert one == two and one


ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62), (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62),
    (2, None, "en", "a", None), (3, "", None, None, 0), (None, "words without a number for them", "en", None, 31), (None, None, None, None, None),
    (4, "word of a very long text " * 30_000, "de", "b", 750_000), (5, " \n\t ", "de", "b", 4), (6, "Ñandú 漢字 😀", "es", "c", 10)]
CLASHES = ("score", "predicted", "shard", "size", "_place", "_row", "row", "print", "contaminated", "n_words", "position", "_group", "_kind", "slot", "class_id")


def folder_of(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_rows_through_all_stages(spark, tmp_path):
    folder = folder_of(spark, tmp_path, ODD)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name == "near_duplicates":
            # Of repeated rows one stays; rows without words are no copies of each other.
            ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
            assert ids == [(False, i) for i in range(1, 7)] + [(True, 0), (True, 0)]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) == len(docs.collect()) and all(0 <= r["shard"] < 24 for r in rows)


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [])).collect() == []
