"""Writers. Site folders are written through a rebalance, so one large site fills many files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.sources.readers import article_rows, compacted_batch, read_articles


def _by_site(df: DataFrame) -> DataFrame:
    return df.hint("rebalance", "site")


def write_articles(df: DataFrame, path: str, batch: int = 0) -> None:
    """Write one batch of changed rows. Writing the same batch again replaces it, so retries are safe."""
    folder = f"{path}/batch={batch}"
    _by_site(df.drop("batch")).write.mode("overwrite").partitionBy("site").parquet(folder)


def compact_articles(spark: SparkSession, path: str, target: str | None = None) -> None:
    """Fold all batches into one, at a fresh path ``target`` or in place.

    In place the folded rows become a version beside the batches, and a pointer to it is written last: a reader sees the
    whole old state or the whole new one, and a compaction that broke off leaves nothing that is read. Batches up to the version
    are not read any more. Doing it again without new batches changes nothing.
    """
    last = article_rows(spark, path).agg(F.max("batch")).first()[0]
    if target is not None:
        write_articles(read_articles(spark, path), target, last)
    elif last is not None and last != compacted_batch(spark, path):
        write_articles(read_articles(spark, path), f"{path}/_base", last)
        pointer = spark.range(1).select(F.lit(last).cast("bigint").alias("upto"))
        pointer.write.mode("overwrite").json(f"{path}/_versions/upto={last}")


def encode_nested(df: DataFrame) -> DataFrame:
    """JSON text for nested columns, for stores that have none."""
    for name in ("tags", "extras", "pictures"):
        if name in df.columns:
            df = df.withColumn(name, F.to_json(name))
    return df


def write_documents(docs: DataFrame, path: str, batch: int = 0) -> None:
    """``(site, doc_name, body, n_bytes)``; a document counts as written when it has bytes.

    Earlier batches stay; writing the same batch again replaces it.
    """
    rows = docs.select("site", "doc_name", "body", "n_bytes")
    _by_site(rows).write.mode("overwrite").partitionBy("site").parquet(f"{path}/batch={batch}")


def write_image_manifest(images: DataFrame, path: str, batch: int = 0) -> None:
    """The images to fetch, in a folder per batch as for documents."""
    _by_site(images).write.mode("overwrite").partitionBy("site").parquet(f"{path}/batch={batch}")
