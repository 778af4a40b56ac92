"""Article links of listings that arrive batch by batch.

State is two tables, a folder per batch: ``listings``, the resolved links and next link of every page that can be a
listing, and ``reached``, the listings that next links lead to from the start URLs. A batch extends the closure only
by the next links of its own pages and by those that earlier pages left open; listings that are reached already and
their markup are not walked again. Batches in any order give the links of one run over all pages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import frontier
from galley.plans.run import listing_tree, start_listings

LISTINGS = "site STRING, url STRING, links ARRAY<STRING>, next_url STRING"
REACHED = "site STRING, url STRING"


def all_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch BIGINT").option("basePath", path).parquet(path)


def earlier(spark: SparkSession, path: str, schema: str, number: int, read=None) -> DataFrame:
    """Rows of the batches before ``number``: a batch that is retried does not see what its first attempt wrote."""
    try:
        rows = read(spark, path) if read else all_batches(spark, path, schema)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise  # only a state that is not there yet is no state
        rows = spark.createDataFrame([], f"{schema}, batch BIGINT")
    return rows.filter(F.col("batch") < number)


def discover_links(pages: DataFrame, sites: DataFrame, out_dir: str, number: int) -> tuple[DataFrame, DataFrame]:
    """``(site, url)`` of the article links that this batch adds, and ``(site, url)`` of all listings reached so far."""
    spark = pages.sparkSession
    listings, reached = f"{out_dir}/listings", f"{out_dir}/reached"
    listing_tree(pages, sites).select("site", "url", "links", "next_url").write.mode("overwrite").parquet(f"{listings}/batch={number}")
    came = spark.read.schema(LISTINGS).parquet(f"{listings}/batch={number}")
    known = earlier(spark, reached, REACHED, number).select("site", "url").distinct()
    by = ["site", "url"]
    edges = earlier(spark, listings, LISTINGS, number).drop("batch").unionByName(came)
    waiting = edges.join(known, by, "left_anti")
    # what known listings lead to is known too, but for those that come only now
    onward = came.join(known, by, "left_semi").filter("next_url IS NOT NULL").select("site", F.col("next_url").alias("url"))
    starts = start_listings(sites).unionByName(onward)
    grown = frontier.reachable_listings(waiting.select("url", "next_url"), starts).select(*by).join(known, by, "left_anti")
    grown.write.mode("overwrite").parquet(f"{reached}/batch={number}")
    grown = spark.read.schema(REACHED).parquet(f"{reached}/batch={number}")
    links = waiting.join(grown, by, "left_semi").unionByName(came.join(known, by, "left_semi"))
    return links.select("site", F.explode("links").alias("url")), known.unionByName(grown)
