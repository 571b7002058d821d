"""Deletion in place, cascades over shared children, and versions of a dimension."""

import datetime as dt
import pathlib

from sievegate.operators.maintenance import cascade_graph
from sievegate.session import shared_dir
from sievegate.sources.sinks import delete_in_place, replace_partitions, with_partition
from sievegate.streaming.state import with_valid_dimension


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_untouched_files_keep_their_names(spark, tmp_path):
    shared_dir(spark)
    path = f"{tmp_path}/rows"
    rows = with_partition(spark.range(400).selectExpr("id k", "id * 2 v"), "k", 32)
    replace_partitions(rows, path, ["part"])
    before = files(path)
    lonely = rows.where("part = 5").select("k")  # all rows of one partition
    keys = lonely.unionByName(rows.where("k IN (7, 8)").select("k")).unionByName(spark.createDataFrame([(10_000,)], "k long"))
    hit = delete_in_place(spark, path, keys, "k", 32)
    after = files(path)
    parts = {f"part={p}" for p in hit}
    assert 5 in hit and len(hit) <= 4
    assert {f: t for f, t in before.items() if f.parts[0] not in parts} == {f: t for f, t in after.items() if f.parts[0] not in parts}
    gone = {r["k"] for r in keys.collect()}
    left = spark.read.parquet(path)
    assert sorted(r["k"] for r in left.collect()) == [k for k in range(400) if k not in gone]
    assert left.where("part = 5").count() == 0 and left.columns == ["k", "v", "part"]


def test_cascade_reaches_what_hangs_on_anything_lost(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    tables = {
        "a": frame([(1,), (2,), (3,)], "k"), "b": frame([(10, 1), (11, 2), (12, 2), (13, None)], "k a"),
        "c": frame([(20, 10, 3), (21, 12, 1), (22, 13, 2), (23, 13, 3)], "k b a"), "alone": frame([(9,)], "k")}
    links = [("b", "a", "a", "k"), ("c", "b", "b", "k"), ("c", "a", "a", "k")]
    lost = cascade_graph(tables, links, "a", frame([(2,), (2,), (77,)], "k"))
    assert {n: sorted(r["k"] for r in df.collect()) for n, df in lost.items()} == {"a": [2], "b": [11, 12], "c": [21, 22]}
    none = cascade_graph(tables, links, "a", frame([], "k"))
    assert all(df.isEmpty() for df in none.values())


def test_rows_meet_the_version_of_their_time(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    versions, seen = [(1, day(2), "one"), (1, day(5), "two"), (2, day(3), "other")], []
    read = lambda: spark.createDataFrame(versions, "k long, valid_from timestamp, label string")
    write = with_valid_dimension(read, ["k"], "ts", lambda batch, i: seen.extend((i, r["id"], r["label"]) for r in batch.collect()))
    rows = lambda *r: spark.createDataFrame(list(r), "id long, k long, ts timestamp")
    write(rows((1, 1, day(1)), (2, 1, day(2)), (3, 1, day(9)), (4, 2, day(4)), (5, 7, day(4)), (6, None, day(4))), 0)
    versions.append((1, day(8), "three"))
    write(rows((7, 1, day(9)), (8, 1, day(4))), 1)
    assert sorted(seen) == [(0, 1, None), (0, 2, "one"), (0, 3, "two"), (0, 4, "other"), (0, 5, None), (0, 6, None),
                            (1, 7, "three"), (1, 8, "one")]
