"""Table sources: Parquet scans and small constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread_small(df: DataFrame) -> DataFrame:
    """Deal rows out when a scan has fewer partitions than there are cores.

    Text work is bound by the processor, and a small table is often one row group.
    Large tables have enough splits and are left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are about to be worked on."""
    return spread_small(table(spark, folder, name))


def rows_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A constant table as a local relation, so that it needs no Python workers."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    types = [part.strip().split(" ", 1)[1] for part in schema.split(",")]

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, (int, float)):
            return str(value)
        if isinstance(value, list):
            return "array(" + ", ".join(literal(v) for v in value) + ")"
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(names)})")
