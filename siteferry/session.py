"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this library wants; every one is a plain Spark SQL setting.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # of a key written twice in one JSON object the last counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def session(app: str = "siteferry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; keyword arguments override (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Reads ``spark.checkpoint.dir``. Only a local-mode session without that setting (tests, a laptop)
    gets a temporary folder; on a cluster the setting is required, since a folder of one machine is
    lost with the machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="siteferry-"))
    return context.getCheckpointDir()


def staging_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder once and reads it back, so later branches see one and the same result.

    A written table is computed once, where a checkpoint computes its last stage twice.
    """
    path = staging_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
