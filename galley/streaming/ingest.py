"""New page files through Structured Streaming, each URL handled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from galley.functions.urls import site_key
from galley.operators import frontier
from galley.operators.joins import small_broadcast
from galley.plans.run import listing_hosts, process_pages
from galley.schemas import ARTICLES, PAGES
from galley.session import cut_lineage
from galley.sources.readers import article_rows, read_articles
from galley.sources.writers import write_articles, write_documents, write_image_manifest
from galley.streaming.discovery import discover_links, earlier


def ingest(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    sites: DataFrame,
    as_of: Column,
    dedupe: str = "state",
    max_files: int | None = None,
    event_time: str | None = None,
    delay: str = "1 day",
    discover: bool = False,
    **inputs,
) -> StreamingQuery:
    """Start a run over the page files that are new in ``in_dir``; it ends when they are done.

    ``dedupe='state'`` leaves out URLs the state has published, whenever that was. ``'watermark'``
    drops repeats within ``delay`` of each other before the batch, for pages with a time column
    ``event_time``: bounded memory in place of a look at the state's whole history.

    A page belongs to the site its URL has in the state, whatever its own host is; else to the first site that starts
    on its host, else to its host. With ``discover`` only those URLs are articles that the state or a reached listing names:
    links of listings join the state as they arrive, and pages that come before their listing wait for it.

    Each batch writes below its own number, counted from one, so one that is retried replaces its own output; a
    state from elsewhere can stand in batch 0.
    """
    schema = PAGES if event_time is None else f"{PAGES}, {event_time} TIMESTAMP"
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    pages = reader.parquet(in_dir)
    if dedupe == "watermark":
        if event_time is None:
            raise ValueError("dedupe='watermark' needs event_time")
        pages = pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
    state_dir = f"{out_dir}/articles"

    def batch(rows: DataFrame, number: int) -> None:
        session, number = rows.sparkSession, number + 1
        state = earlier(session, state_dir, ARTICLES, number, article_rows).groupBy("url").agg(
            F.max_by(F.struct("site", "publish"), "batch").alias("row")).select("url", "row.*")
        rows = rows.select("page_id", "url", "html").join(state.filter("publish").select("url"), "url", "left_anti")
        if discover:
            links, listings = discover_links(rows, sites, out_dir, number)
            fresh = cut_lineage(frontier.discover(links, state).select("url", "site", "publish"))
            todo = state.filter("NOT publish").unionByName(fresh, allowMissingColumns=True)
            waiting = earlier(session, f"{out_dir}/waiting", PAGES, number).drop("batch")
            named = rows.join(todo.select("url"), "url", "left_semi")
            nameless = rows.join(todo.select("url"), "url", "left_anti").join(listings.select("url").distinct(), "url", "left_anti")
            nameless.select("page_id", "url", "html").write.mode("overwrite").parquet(f"{out_dir}/waiting/batch={number}")
            rows = cut_lineage(named.unionByName(waiting.join(fresh.select("url"), "url", "left_semi")))
            seen = todo.join(rows.select("url").distinct(), "url", "left_semi").unionByName(fresh).dropDuplicates(["url"])
        else:
            own = site_key(F.col("url"))
            hosts = listing_hosts(sites).groupBy("host").agg(F.min("site").alias("first"))
            seen = rows.select("url", own.alias("host")).dropDuplicates(["url"]).join(state.select("url", "site"), "url", "left")
            seen = seen.join(small_broadcast(hosts, 50_000), "host", "left").select(
                "url", F.coalesce("site", "first", "host").alias("site"), F.lit(False).alias("publish"))
        articles = session.createDataFrame([], ARTICLES).unionByName(seen, allowMissingColumns=True)
        result = process_pages(rows, sites, articles, as_of, **inputs)
        write_documents(result.documents, f"{out_dir}/documents", number)
        write_image_manifest(result.images, f"{out_dir}/images", number)
        write_articles(result.articles, state_dir, number)

    return (
        pages.writeStream.foreachBatch(batch)
        .option("checkpointLocation", f"{out_dir}/progress")
        .trigger(availableNow=True)
        .start()
    )


def published(spark: SparkSession, out_dir: str) -> DataFrame:
    """State after the batches so far."""
    return read_articles(spark, f"{out_dir}/articles")
