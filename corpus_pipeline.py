"""Training-data pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievegate.llm.common import unused  # noqa: E402
from sievegate.llm.decontamination import decontaminate  # noqa: E402
from sievegate.llm.mixing import ordered_mix  # noqa: E402
from sievegate.llm.queries import SHARDS  # noqa: E402
from sievegate.llm.sharding import shard_documents, with_place  # noqa: E402
from sievegate.llm.similar import one_of_each  # noqa: E402
from sievegate.llm.toxicity import fit, remove_toxic  # noqa: E402
from sievegate.session import shared_dir  # noqa: E402
from sievegate.sources.tables import table  # noqa: E402

#: Toxicity scores, chosen paths and training models have no SQL form.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on the labels does not predict toxic.

    Null texts and texts without words have the score of no words and stay; equal texts go or stay
    together. Without documents or labels nothing is predicted toxic.
    """
    return remove_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the smallest doc_id's.

    A null doc_id comes last; of repeated rows one stays. Null texts and texts without words are copies
    of nothing and all stay. No documents stay no documents.
    """
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have none; repeated rows go or stay together; an empty benchmark removes nothing.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Readings of the documents in training order: a document is there as often as it is read.

    Documents that the mix takes nothing of, as those without words, are gone; a null source is a source of
    its own, the last one; readings of one position go by doc_id. No documents give no readings.
    """
    return ordered_mix(docs, columns=docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, and their slot in it, in training order.

    Equal ids, null ones too, share a shard; null texts count as empty; repeated rows have slots of their
    own. Columns named like the added ones are replaced, all others stay, whatever their names.
    """
    place = unused(docs, "_place")
    return shard_documents(with_place(docs, place), SHARDS, place=place)


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
    ("mix", mix), ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
