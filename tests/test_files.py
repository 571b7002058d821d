"""Files written and read as rows, in batches and as a stream; places in listings; jobs folded in runs."""

import random

import pytest
from pyspark.sql import functions as F

from sievegate.operators import maintenance as mt
from sievegate.sources import files as fl
from sievegate.streaming.ingest import run_available

OBJECTS = [
    ("lang=en/a.txt", b"Plain  words\xff here"), ("lang=en/deep/b.MD", "é\n\n\nü".encode()), ("lang=de/c.pdf", b"%PDF"),
    ("lang=de/d.txt", b" \n"), ("lang=de/e.txt", None), ("lang=de/f.xyz", b"unknown ends are text"), ("lang=de/f.xyz", b"unknown ends are text"),
]


def objects(spark, rows=OBJECTS):
    return spark.createDataFrame(rows, "object_key string, content binary").repartition(3)


def outcomes(rows):
    return {r["name"]: (r["kind"], r["outcome"], r["text"]) for r in rows.collect()}


WANTED = {
    "a.txt": ("text", "ok", "Plain words here"), "c.pdf": ("pdf", "needs_reader", "%PDF"), "d.txt": ("text", "no_text", ""),
    "f.xyz": ("text", "ok", "unknown ends are text")}


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "tree")
    assert fl.write_objects(objects(spark), path) == len(OBJECTS)
    assert fl.write_objects(objects(spark), path) == len(OBJECTS)  # a second run leaves the same files
    files = fl.read_objects(spark, path, "lang string")
    assert {(r["name"], r["lang"], r["length"]) for r in files.collect()} >= {("a.txt", "en", 18), ("c.pdf", "de", 4), ("d.txt", "de", 2)}
    rows = outcomes(fl.parsed_rows(files, ["name"]))
    assert len(rows) == 5 and rows.items() >= WANTED.items() and rows["b.MD"][1] == "ok"
    pruned = files.where("lang = 'de'")
    assert pruned.count() == 3 and "PartitionFilters: [isnotnull(lang" in pruned._jdf.queryExecution().toString()


def test_no_objects(spark, tmp_path):
    assert fl.write_objects(objects(spark, []), str(tmp_path / "none")) == 0


@pytest.mark.parametrize("key", [None, "", "/abs", "../out", "a/../../b"])
def test_keys_stay_inside(spark, tmp_path, key):
    with pytest.raises(Exception, match="not a key inside the folder"):
        fl.write_objects(objects(spark, [(key, b"x")]), str(tmp_path / "tree"))


def test_stream_parses_each_file_once(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("tree", "out", "cp"))
    for part in (OBJECTS[:3], OBJECTS[3:], OBJECTS[3:]):
        fl.write_objects(objects(spark, part), path)
        run_available(fl.stream_objects(spark, path, "lang string"), fl.store_parsed(out, ["name", "lang"]), checkpoint)
    rows = spark.read.parquet(out)
    assert rows.count() == 5
    got = outcomes(rows)
    assert got["a.txt"] == WANTED["a.txt"] and got["c.pdf"] == ("pdf", "needs_reader", None) and got["d.txt"][1] == "no_text"


def test_places_of_a_hot_scope(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(None)).alias("scope"), (F.col("id") * 7919 % 3001).alias("v"))
    got = mt.ordered_places(rows, [F.col("scope")], [F.col("v").desc()]).collect()
    lists = {}
    for r in got:
        lists.setdefault(r["scope"], []).append((r["place"], r["v"]))
    assert len(got) == 3000 and len(lists) == 8
    for items in lists.values():
        items.sort()
        assert [p for p, _ in items] == list(range(len(items)))
        assert [v for _, v in items] == sorted((v for _, v in items), reverse=True)
    assert mt.ordered_places(rows.limit(0), [F.col("scope")], [F.col("v")]).count() == 0


def test_jobs_folded_in_runs(spark):
    draw = random.Random(5)
    names = [*mt.JOB_EVENTS, "unknown", None]
    events = [(draw.choice([1, 1, 1, 2, 3]), i, draw.randrange(40), draw.choice(names)) for i in range(600)]
    moves = {("queue", "new"): "queued", ("queue", "pending_approval"): "queued", ("start", "queued"): "running",
             ("succeed", "running"): "succeeded", ("fail", "running"): "failed", ("cancel", "queued"): "failed",
             ("cancel", "running"): "failed", ("retry", "failed"): "queued"}
    want = {}
    for job, _, _, event in sorted(events, key=lambda e: (e[2], e[1])):
        status, retries, n = want.get(job, ("new", 0, 0))
        after = moves.get((event, status), status)
        want[job] = (after, retries + (event == "retry" and status == "failed"), n + 1)
    table = spark.createDataFrame(events, "job_id long, event_id long, created_at long, event string").repartition(5)
    for longest in (4, 1000):
        got = {r["job_id"]: (r["status"], r["retries"], r["n_events"]) for r in mt.fold_jobs(table, longest).collect()}
        assert got == want
    assert mt.fold_jobs(table.limit(0)).count() == 0
