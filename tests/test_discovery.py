"""Streaming runs against one run over all pages."""

import pytest
from pyspark.sql import functions as F

from galley.checks.jobs import site_rules
from galley.plans.run import run
from galley.schemas import ARTICLES, PAGES
from galley.sources import read_articles, write_articles
from galley.streaming import ingest


def rules(spark):
    starts = spark.createDataFrame([("s.test", "http://hub.test/1"), ("t.test", "http://t.test/1")], "site STRING, start STRING")
    sites = site_rules(spark, "", sites=starts)
    paging = F.col("selectors").withField("list.next", F.lit("a.next"))
    return sites.withColumn("selectors", paging)


def listing(number, links, following=None):
    items = "".join(f'<li><a href="{link}">x</a></li>' for link in links)
    after = f'<a class="next" href="{following}">n</a>' if following else ""
    return f"<html><body><nav><ul>{items}</ul></nav>{after}</body></html>"


def article(title):
    return f"<html><body><h1>{title}</h1><article><p>Words of {title} stand here.</p></article></body></html>"


PAGES_GIVEN = [
    (1, "http://hub.test/1", listing(1, ["http://a.test/x", "http://b.test/y"], "/2")),
    (2, "http://hub.test/2", listing(2, ["http://a.test/z"], "/3")),
    (3, "http://hub.test/3", listing(3, ["http://c.test/w", "http://a.test/x"], "/1")),
    (4, "http://hub.test/9", listing(9, ["http://never.test/q"])),
    (5, "http://t.test/1", listing(1, ["/own"])),
    (10, "http://a.test/x", article("Ex")), (11, "http://b.test/y", article("Why")), (12, "http://a.test/z", article("Zed")),
    (13, "http://c.test/w", article("Double")), (14, "http://t.test/own", article("Own")), (15, "http://never.test/q", article("Never")),
]


@pytest.mark.parametrize("lots", [[(3, 10, 14), (1, 12, 13), (2, 4, 5, 11, 15)]])
def test_listings_in_any_order_give_one_run(spark, tmp_path, lots):
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    pages = spark.createDataFrame(PAGES_GIVEN, PAGES)
    whole = run(spark, rules(spark), pages, spark.createDataFrame([], ARTICLES), as_of).articles
    for lot in lots:
        pages.filter(F.col("page_id").isin(*lot)).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), rules(spark), as_of, discover=True).awaitTermination()
    fields = ("url", "site", "title", "publish")
    got = read_articles(spark, str(tmp_path / "out/articles")).select(*fields)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*fields).collect()))
    assert got.count() == 5


def test_site_comes_from_the_state(spark, tmp_path):
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    state = spark.createDataFrame([("http://news.test/1", "s.test", False)], "url STRING, site STRING, publish BOOLEAN")
    write_articles(spark.createDataFrame([], ARTICLES).unionByName(state, allowMissingColumns=True), str(tmp_path / "out/articles"))
    pages = spark.createDataFrame([(1, "http://news.test/1", article("One")), (2, "http://hub.test/5", article("Two"))], PAGES)
    pages.write.parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), rules(spark), as_of).awaitTermination()
    got = {r.url: (r.site, r.title, r.publish) for r in read_articles(spark, str(tmp_path / "out/articles")).collect()}
    assert got == {"http://news.test/1": ("s.test", "One", True), "http://hub.test/5": ("s.test", "Two", True)}


def test_run_takes_a_dictionary_table(spark):
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    page = "<html><body><h1>题</h1><article><p>中文分词很好，中文分词真好。</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://t.test/1", listing(1, ["/cjk"])), (2, "http://t.test/cjk", page)], PAGES)
    words = spark.createDataFrame([("中文分词",), (None,), ("很好",)], "term STRING")
    keep = rules(spark).withColumn("extract", F.lit(True))
    tags = run(spark, keep, pages, spark.createDataFrame([], ARTICLES), as_of, dictionary=words).articles.first().tags
    assert "中文分词" in tags and "中" not in tags
