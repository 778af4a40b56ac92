"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.session import checkpoint_folder

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares."""
    return f"{checkpoint_folder(spark).rstrip('/')}/galley-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps re-read it after a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text"):
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def least_hashed(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """The ``limit`` rows of least hash of the columns, the same however rows are dealt.

    Only rows below a hash that about twice as many rows are under are sorted, so that no task gets more.
    """
    hashed = df.withColumn("HASH", F.xxhash64(*columns))
    count = df.count()
    if count > 4 * limit:
        hashed = hashed.filter(F.col("HASH") < int((2 * limit / count - 0.5) * 2.0 ** 64))
    return hashed.orderBy("HASH", *columns).limit(limit).drop("HASH")
