"""Session settings the rest of the package relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "galley", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # pages are large rows: keep the batches that cross to Python small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        # large expressions are built faster without a record of each call's place in the source
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it.

    A folder of our own is made only for a local master: on a cluster every
    executor has to reach it, so an unset folder there is an error.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="galley-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that a lost executor re-reads it instead of recomputing it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written_once(df: DataFrame) -> DataFrame:
    """Write a table that several branches read to the shared folder, packed by columns, and read it back."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/galley-once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
