"""Which texts may need compatibility folding, and what it costs to know; files of other readers are not decoded."""

import re
import time
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from sievegate.functions import text as tx
from sievegate.sources import files as fl

# Letters that stay as they are unless a combining mark follows.
STAYS = r"[\x00-\x7FÀ-ıĴ-ľŁ-ňŊ-žƠơƯưẠ-ỹ]"


def test_every_letter_is_found_or_stays(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(pd.DataFrame({"id": codes, "c": [chr(c) for c in codes]}))
    found = rows.where(~F.col("c").rlike(tx._MAY_FOLD)).select("id").toPandas()["id"]
    assert set(found) == {c for c in codes if re.match(STAYS, chr(c))}
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) for c in found)


def test_folding_is_that_of_python(spark):
    texts = ["plain", "", None, "caffè", "cafè", "ﬁne", "Ｗｉｄｅ", "½ m²", "Ĳ ŉ ŀ ſ", "Đặng Ự", "ƣẞ", "…", "x y", "😀", "𝒜", "éé"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.compatibility_fold("t").alias("t"))
    assert [r["t"] for r in rows.orderBy("i").collect()] == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_looking_for_such_letters_costs_as_other_patterns(spark):
    rows = spark.range(0, 16, 1, 8).selectExpr("repeat('été plain words of one long text, ', 60000) t").cache()

    def seconds(c):
        took = []
        for _ in range(3):
            began = time.time()
            rows.select(c).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    seconds(F.length("t"))
    other = seconds(F.length(F.regexp_replace("t", "[\\u200B-\\u200D\\uFEFF]", "")))
    assert seconds(F.length(tx.compatibility_fold("t"))) < 0.5 + 5 * other
    rows.unpersist()


def test_files_of_other_readers_are_not_decoded(spark, tmp_path, monkeypatch):
    others = spark.sparkContext.accumulator(0)

    def decode(raw):
        if raw is None:
            return None
        others.add(raw.startswith((b"%PDF", b"PK", b"PNG")))
        return raw.decode()

    counted = F.udf(decode, "string").asNondeterministic()
    monkeypatch.setattr(fl, "tx_decode", counted)
    files = [("a.txt", "", b"words"), ("b.pdf", "", b"%PDF"), ("c.docx", "", b"PK"), ("d", "image/png", b"PNG"), ("e", "", b"more words"), ("f.md", "", b"")]
    batch = spark.createDataFrame(files, "name string, mime string, content binary")
    fl.store_parsed(f"{tmp_path}/out", ["name"])(batch, 0)
    got = {r["name"]: (r["kind"], r["outcome"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a.txt": ("text", "ok", "words"), "b.pdf": ("pdf", "needs_reader", None), "c.docx": ("docx", "needs_reader", None),
                   "d": ("image", "needs_reader", None), "e": ("text", "ok", "more words"), "f.md": ("text", "no_text", None)}
    assert others.value == 0
