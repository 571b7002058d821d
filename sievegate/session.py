"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", app: str = "sievegate", **extra: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false",
                       "spark.ui.showConsoleProgress": "false", **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach, from `spark.checkpoint.dir`; also set for checkpoints.

    A cluster has to name one. Only a session whose executors are threads of this process, as in
    tests, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not configured and current.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
        configured = tempfile.mkdtemp(prefix="sievegate-")
    if current.isEmpty():
        context.setCheckpointDir(configured)
    return configured or current.get()
