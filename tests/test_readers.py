"""Texts stay where they lie when they meet their readers, and are scanned for no more than is asked."""

from pyspark.sql import functions as F

from sievegate.operators import access as ac
from sievegate.operators import detection as dt


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_dealt_by_reader(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id doc_id", "if(id % 9 = 0, null, id % 3) user_id", "repeat('x', 50) text")
    profile = spark.range(1, 50).selectExpr("id user_id", "id % 5 max_clearance")
    wanted = rows.join(profile, "user_id").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = ac.with_profiles(rows, profile, "doc_id")
        joins = [line for line in plan(few).splitlines() if "SortMergeJoin" in line]
        assert "BroadcastHashJoin" in plan(few) and all("LeftSemi" in line for line in joins)
        monkeypatch.setattr(ac, "PROFILES_BROADCAST", 1)
        many = ac.with_profiles(rows, profile, "doc_id").select(few.columns)
        assert sorted(few.collect()) == sorted(many.collect()) == sorted(wanted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_personal_data_known_without_spans(spark):
    texts = ["", " ", None, "gọi 0912 345 678", "a@b", "a@b.vn", "10.0.0.7", "123456789", "12345678", "Nguyễn Văn An", "API KEY", "the NDA, m&A", "B1234567"]
    rows = spark.createDataFrame([(i, t, "BLOCK") for i, t in enumerate(texts)], "doc_id int, text string, judge_action string")
    got = dt.scan_responses(rows).withColumn("n", F.size(dt.pii_spans(F.col("text"))))
    for r in got.collect():
        assert r["has_pii"] == (r["n"] > 0), r
        hard, soft = r["hard_secrets"], r["soft_secrets"]
        assert r["trigger"] == ("pii" if r["has_pii"] else "hard_secret" if hard else "soft_secret" if soft else "none"), r
    alone = plan(dt.scan_responses(rows).select("doc_id", "trigger"))
    assert "regexp_extract_all" not in alone and "split(" not in alone
