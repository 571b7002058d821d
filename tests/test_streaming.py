"""Streams against batch results and a test clock."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievegate.operators import access as ac
from sievegate.operators.chunking import ChunkSettings
from sievegate.plans import upkeep
from sievegate.plans.upkeep import run_dir
from sievegate.sources.sinks import append_log, replace_partitions
from sievegate.streaming import ingest as ig
from sievegate.streaming import state as st

T0 = datetime(2024, 1, 1)


def test_grants_expire_by_event_time(spark):
    rows = [(1, "approved", T0, T0 + timedelta(days=1)), (2, "approved", T0, None),
            (3, "pending", T0, None), (4, "approved", T0, T0 + timedelta(days=30))]
    later = [(9, "pending", T0 + timedelta(days=5), None)]
    last = [(10, "pending", T0 + timedelta(days=6), None)]
    schema = "request_id long, status string, created_at timestamp, expires_at timestamp"
    source, out = run_dir(spark, "grants"), run_dir(spark, "grants-out")
    for part in (rows, later, last):
        append_log(spark.createDataFrame(part, schema).coalesce(1), source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ig.run_available(st.expire_grants(stream), lambda b, i: append_log(b.withColumn("b", F.lit(i)), out), run_dir(spark, "cp"))
    got = {r["request_id"] for r in spark.read.parquet(out).where("status = 'revoked'").collect()}
    batch = ac.settle_expiry(spark.createDataFrame(rows, schema), F.lit(T0 + timedelta(days=5)))
    assert got == {r["request_id"] for r in batch.where("status = 'revoked'").collect()} == {1}


def test_extended_and_shortened_grants(spark):
    """The last row of a request decides: made endless, made shorter, taken back before its end."""
    day = timedelta(days=1)
    rows = [[(1, "approved", T0, T0 + 5 * day), (2, "approved", T0, T0 + 30 * day), (3, "approved", T0, T0 + 5 * day)],
            [(1, "approved", T0 + day, None), (2, "approved", T0 + day, T0 + 4 * day), (3, "rejected", T0 + day, None)],
            [(9, "pending", T0 + 8 * day, None)], [(10, "pending", T0 + 9 * day, None)]]
    schema = "request_id long, status string, created_at timestamp, expires_at timestamp"
    source, out = run_dir(spark, "longer"), run_dir(spark, "longer-out")
    for part in rows:
        append_log(spark.createDataFrame(part, schema).coalesce(1), source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ig.run_available(st.expire_grants(stream), lambda b, i: append_log(b.withColumn("b", F.lit(i)), out), run_dir(spark, "cp"))
    assert [r["request_id"] for r in spark.read.parquet(out).where("status = 'revoked'").collect()] == [2]


def expired_by_request(parts):
    """(request, status) rows of each batch, request by request: data of a batch first, then what ran out."""
    open_ends, clock, out, seen = {}, 0, [], 0
    for part in [*parts, []]:
        rows, last = [r for r in part if ms(r[2]) > clock or not clock], {}
        for r in sorted(rows, key=lambda r: r[2]):
            last[r[0]] = r
        for key, (_, status, _, end) in last.items():
            out.append((key, status))
            open_ends.pop(key, None)
            if status == "approved" and end is not None:
                if ms(end) <= clock:
                    out.append((key, "revoked"))
                else:
                    open_ends[key] = ms(end)
        for key in [k for k, end in open_ends.items() if k not in last and end < clock]:
            out.append((key, "revoked"))
            del open_ends[key]
        seen = max([seen, *(ms(r[2]) for r in part)])
        clock = seen
    return out


def ms(moment):
    return int((moment - datetime(1970, 1, 1)).total_seconds() * 1000)


def by_text(rows):
    return sorted((str(key), str(status)) for key, status in rows)


def test_grants_of_many_requests_share_groups(spark):
    """Histories over several batches, in three groups: ids too long for a float, and no id."""
    draw, hour, big = random.Random(3), timedelta(hours=1), 2**60
    ids = [None, big + 1, big + 2, -7, *range(40)]
    parts = []
    for at in range(6):
        times = draw.sample(range(24 * 60), 70)  # no two rows of a batch at one time
        parts.append([(draw.choice(ids), draw.choice(["approved", "approved", "rejected", None]), T0 + at * 24 * hour + timedelta(minutes=m),
                       draw.choice([None, T0 + draw.randrange(150) * hour])) for m in times])
    parts.append([(-1, "pending", T0 + 400 * hour, None)])
    want = by_text(expired_by_request(parts))
    schema = "request_id long, status string, created_at timestamp, expires_at timestamp"
    source = run_dir(spark, "many")
    for part in parts:
        append_log(spark.createDataFrame(part, schema).coalesce(1), source)
    out = run_dir(spark, "many-out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ig.run_available(st.expire_grants(stream, buckets=3), lambda b, i: append_log(b, out), run_dir(spark, "cp"))
    assert by_text(spark.read.parquet(out).collect()) == want
    assert sum(status == "revoked" for _, status in want) >= 20


def test_calls_do_not_grow_with_requests(spark):
    schema = "request_id long, status string, created_at timestamp, expires_at timestamp"
    source, out = run_dir(spark, "crowd"), run_dir(spark, "crowd-out")
    rows = spark.range(6000).selectExpr(
        "id request_id", "'approved' status", "TIMESTAMP '2024-01-01' created_at", "TIMESTAMP '2024-01-02' + make_dt_interval(0, id % 5) expires_at")
    append_log(rows, source)
    stream = st.expire_grants(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.foreachBatch(lambda b, i: append_log(b, out)).option(
        "checkpointLocation", run_dir(spark, "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= st.GRANT_BUCKETS + 1
    assert spark.read.parquet(out).where("status = 'approved'").select("request_id").distinct().count() == 6000


def test_stream_grants_takes_its_first_write_whole(spark, tmp_path):
    """Any number of files: rows of the first write are never later than the clock."""
    events = spark.range(600).selectExpr(
        "id event_id", "CAST(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(id * 37 % 30 as int)) AS TIMESTAMP_NTZ) ts", "id % 9 user_id",
        "'view' event_type", "1.0 value", "'{}' props")
    events.repartition(9).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).selectExpr("id doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = sorted(r["request_id"] for r in upkeep.stream_grants(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert got == [i for i in range(600) if i % 3 == 1 and i % 2]


def test_versions_do_not_depend_on_batches(spark):
    """Two versions of a document in one micro-batch or in two, one delivered twice: the same rows."""
    schema = "doc_id long, version_no int, text string"
    files = [[(1, 1, "First text here."), (2, 1, "Other.")], [(1, 2, "Second text. It is longer.")],
             [(1, 1, "First text here."), (2, 1, "Other.")]]
    source = run_dir(spark, "texts")
    for part in files:
        append_log(spark.createDataFrame(part, schema).coalesce(1), source)
    results = []
    for per_trigger in (1, 16):
        index = run_dir(spark, "texts-index")
        stream = ig.read_versions(spark, source, spark.read.parquet(source).schema, per_trigger)
        ig.run_available(stream, ig.ingest_once(index, ChunkSettings(50, 0, 0)), run_dir(spark, "cp"))
        rows = spark.read.parquet(index)
        results.append(sorted((r["doc_id"], r["version_no"], r["chunk_text"]) for r in rows.collect()))
        assert {(r["doc_id"], r["version_no"]) for r in ig.latest_versions(rows).collect()} == {(1, 2), (2, 1)}
    assert results[0] == results[1] and len(results[0]) == 3


def test_repeated_requests_are_dropped(spark):
    schema = "idempotency_key string, created_at timestamp"
    source, out = run_dir(spark, "requests"), run_dir(spark, "requests-out")
    append_log(spark.createDataFrame([("a", T0), ("a", T0), ("b", T0)], schema).coalesce(1), source)
    append_log(spark.createDataFrame([("a", T0 + timedelta(minutes=5)), ("c", T0)], schema).coalesce(1), source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ig.run_available(st.first_requests(stream), lambda b, i: append_log(b, out), run_dir(spark, "cp"))
    assert sorted(r[0] for r in spark.read.parquet(out).select("idempotency_key").collect()) == ["a", "b", "c"]


def test_dimension_is_read_again_per_batch(spark):
    source, out, dim = run_dir(spark, "facts"), run_dir(spark, "facts-out"), run_dir(spark, "dim")
    append_log(spark.createDataFrame([("x", 1)], "k string, v int").coalesce(1), source)
    append_log(spark.createDataFrame([("x", 2)], "k string, v int").coalesce(1), source)
    replace_partitions(spark.createDataFrame([("x", "old", 0)], "k string, name string, p int"), dim, ["p"])

    def write(rows, batch_id):
        append_log(rows.select("k", "v", "name"), out)
        if batch_id == 0:
            replace_partitions(spark.createDataFrame([("x", "new", 0)], "k string, name string, p int"), dim, ["p"])

    stream = spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).parquet(source)
    ig.run_available(stream, st.with_fresh_dimension(lambda: spark.read.parquet(dim), ["k"], write), run_dir(spark, "cp"))
    assert sorted(r["name"] for r in spark.read.parquet(out).collect()) == ["new", "old"]
