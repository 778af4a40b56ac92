"""Whole jobs over the pages: batch and incremental."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.checks.links import scratch
from galley.checks.registry import ARTICLE_HTML, H1, check, decode_sql, table, tokens_sql
from galley.functions import text as T
from galley.functions.urls import site_key
from galley.plans.run import run
from galley.schemas import ARTICLES, SITE_FILE
from galley.sources import read_articles, read_documents, read_pages, read_sites, read_stopwords
from galley.sources.readers import with_removal_pattern
from galley.streaming import ingest

AS_OF = "2024-01-01 00:00:00+00:00"


def site_rules(spark, folder, extract: bool = False, sites=None):
    """One rule per host of the pages, or per row of ``sites(site, start)``."""
    hosts = sites if sites is not None else table(spark, folder, "pages").select(
        site_key(F.col("url")).alias("site")).distinct().withColumn("start", F.concat(F.lit("http://"), "site", F.lit("/")))
    empty = F.array().cast("array<string>")
    article = F.struct(
        F.lit("h1").alias("title"), F.lit("nav li > a").alias("tags"), F.lit("").alias("excerpt"), F.lit("article").alias("content"),
        F.lit("").alias("date"), F.create_map(F.lit("first"), F.lit("nav a")).alias("extras"))
    selectors = F.struct(
        F.struct(F.lit("nav a").alias("article"), F.lit("").alias("next")).alias("list"), article.alias("article"),
        F.struct(F.array(F.lit("div.ad"), F.lit("")).alias("tags"), F.array(F.lit("<script(.*?)>"), F.lit("(")).alias("regex")).alias("remove"),
        F.struct(F.array(F.lit("there")).alias("titles"), F.array(F.lit("###")).alias("words")).alias("filter"))
    rows = hosts.select(
        F.col("site"), F.col("site").alias("name"), F.array("start").alias("start_urls"),
        selectors.alias("selectors"), F.when(F.length("site") % 2 == 0, F.lit("hexo")).otherwise(F.lit("hugo")).alias("cms"),
        F.array(F.lit("")).alias("categories"), F.lit("").alias("author"), F.lit("/images").alias("imgprefix"), F.lit(extract).alias("extract"),
        F.struct(F.lit("a").alias("text"), F.lit("").alias("password")).alias("watermark"),
        F.struct(empty.alias("stopwords"), F.array().cast("array<array<string>>").alias("replacements"), F.lit("-").alias("separator")).alias("slugify"),
        F.struct(empty.alias("filter"), F.array(F.lit("The")).alias("require")).alias("tokenizer"))
    typed = spark.createDataFrame([], SITE_FILE).withColumn("site", F.lit("")).filter("false")
    return with_removal_pattern(typed.unionByName(rows))


def _state(spark, folder):
    pages = table(spark, folder, "pages").select("url", site_key(F.col("url")).alias("site"), F.lit(False).alias("publish"))
    return spark.createDataFrame([], ARTICLES).unionByName(pages, allowMissingColumns=True)


EXPECTED = rf"""
  p AS (SELECT page_id, url, {H1} AS title, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="/([^"]*)"', 1) AS w,
      list_transform(regexp_extract_all({ARTICLE_HTML}, '(?s)<p>(.*?)(?:</p>|<br>)', 1), lambda x: {decode_sql("regexp_replace(x, '<[^>]*>', '', 'g')")}) AS ps,
      {decode_sql(ARTICLE_HTML)} AS body FROM pages),
  k AS (SELECT *, contains(title, 'there') OR contains(body, '###') AS dropped FROM p),
  x AS (SELECT url, CASE WHEN NOT dropped THEN regexp_replace(title, '^\s+|\s+$', '', 'g') END AS title, CASE WHEN NOT dropped THEN CASE WHEN length(coalesce(nullif(ps[1], ''), ps[2])) > 60
      THEN coalesce(nullif(ps[1], ''), ps[2]) ELSE '' END END AS excerpt, CASE WHEN NOT dropped THEN w[1] END AS first,
      CASE WHEN NOT dropped THEN array_to_string(list_filter(w, lambda t: regexp_matches(t, '[a-zA-Z]')), '|') END AS tags, NOT dropped AS publish FROM k)
"""


@check(f"WITH {EXPECTED} SELECT url, title, excerpt, first, tags, publish FROM x")
def article_job(spark, folder):
    pages = read_pages(spark, f"{folder}/pages.parquet")
    result = run(spark, site_rules(spark, folder), pages, _state(spark, folder), F.to_timestamp(F.lit(AS_OF)), discover=False)
    return result.articles.select("url", "title", "excerpt", F.col("extras")["first"].alias("first"),
                                  F.array_join("tags", "|").alias("tags"), "publish")


@check()
def keyword_job(spark, folder):
    pages = read_pages(spark, f"{folder}/pages.parquet")
    result = run(spark, site_rules(spark, folder, True), pages, _state(spark, folder), F.to_timestamp(F.lit(AS_OF)), discover=False)
    return result.documents.select("site", "doc_name", "n_bytes")


@check(f"WITH {EXPECTED} SELECT url, title, publish FROM x")
def incremental_job(spark, folder):
    out, source = scratch(spark, "incremental"), scratch(spark, "incoming")
    pages = table(spark, folder, "pages")
    for part in range(2):  # files arrive in two lots, the second with every third page again
        lot = pages.filter(f"page_id % 2 = {part} OR (page_id % 3 = 0 AND {part} = 1)")
        lot.write.mode("append").parquet(source)
        ingest(spark, source, out, site_rules(spark, folder), F.to_timestamp(F.lit(AS_OF))).awaitTermination()
    return read_articles(spark, f"{out}/articles", ["title", "publish"])


@check(f"""
WITH {EXPECTED} SELECT x.url, 'site' || page_id // 16 || '.test' AS site, publish,
  CASE WHEN publish THEN '202401010800000800-' || md5(x.url) || '.md' END AS doc_name FROM x JOIN pages USING (url)
""")
def cross_host_job(spark, folder):
    """Listings on hosts of their own, articles on others, and a second page for every fourth URL."""
    pages, listings, again, sites = cross_host_pages(spark, folder)
    result = run(spark, site_rules(spark, folder, sites=sites), pages.unionByName(listings).unionByName(again),
                 spark.createDataFrame([], ARTICLES), F.to_timestamp(F.lit(AS_OF)))
    return result.articles.join(result.documents.select("url", "doc_name"), "url", "left").select("url", "site", "publish", "doc_name")


def cross_host_pages(spark, folder):
    pages = table(spark, folder, "pages").withColumn("k", F.expr("page_id div 16"))
    links = F.array_join(F.collect_list(F.concat(F.lit('<li><a href="'), "url", F.lit('">a</a></li>'))), "")
    listings = pages.groupBy("k").agg(links.alias("links")).select(
        (-F.col("k") - 1).alias("page_id"), F.format_string("http://hub%d.test/list", "k").alias("url"),
        F.concat(F.lit("<html><body><nav><ul>"), "links", F.lit("</ul></nav></body></html>")).alias("html"))
    again = pages.filter("page_id % 4 = 0").select(
        (F.col("page_id") + 1_000_000).alias("page_id"), "url", F.replace("html", F.lit("<h1>"), F.lit("<h1>there ")).alias("html"))
    sites = pages.select(F.format_string("site%d.test", "k").alias("site"), F.format_string("http://hub%d.test/list", "k").alias("start")).distinct()
    return pages.drop("k"), listings, again, sites


@check(f"""
WITH {EXPECTED} SELECT x.url, 'site' || page_id // 16 || '.test' AS site, publish,
  CASE WHEN publish THEN '202401010800000800-' || md5(x.url) || '.md' END AS doc_name FROM x JOIN pages USING (url)
""")
def stream_cross_host_job(spark, folder):
    """The rows of ``cross_host_job`` from three lots: pages before their listings, listings before their pages, second pages last."""
    pages, listings, again, sites = cross_host_pages(spark, folder)
    out, source = scratch(spark, "hubs"), scratch(spark, "incoming")
    rules = site_rules(spark, folder, sites=sites)
    lots = [pages.filter("page_id % 2 = 0").unionByName(listings.filter("page_id % 3 = 0")),
            pages.filter("page_id % 4 = 1").unionByName(listings.filter("page_id % 3 != 0")),
            pages.filter("page_id % 4 = 3").unionByName(again)]
    for lot in lots:
        lot.write.mode("append").parquet(source)
        ingest(spark, source, out, rules, F.to_timestamp(F.lit(AS_OF)), discover=True).awaitTermination()
    state = read_articles(spark, f"{out}/articles", ["site", "publish"]).withColumn("name", F.md5("url"))
    names = read_documents(spark, f"{out}/documents").select("doc_name", F.regexp_extract("doc_name", r"-([0-9a-f]*)\.md", 1).alias("name"))
    return state.join(names, "name", "left").select("url", "site", "publish", "doc_name")


@check(f"WITH {EXPECTED} SELECT url, title, publish FROM x")
def watermark_job(spark, folder):
    """Each page twice within the delay."""
    out, source = scratch(spark, "watermark"), scratch(spark, "incoming")
    pages = table(spark, folder, "pages").withColumn("seen_at", F.timestamp_seconds(F.col("page_id") * 60 + 1_700_000_000))
    for later in range(2):
        pages.withColumn("seen_at", F.col("seen_at") + F.expr(f"interval {later} minutes")).write.mode("append").parquet(source)
    query = ingest(spark, source, out, site_rules(spark, folder), F.to_timestamp(F.lit(AS_OF)), dedupe="watermark",
                   event_time="seen_at", delay="30 days")
    query.awaitTermination()
    return read_articles(spark, f"{out}/articles", ["title", "publish"])


@check(f"""
SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, 'd-' || regexp_extract(url, '^https?://([^/?#]+)', 1) AS name,
  '^(?:(?:<b)|(?:^x))' AS removal_pattern, 2 AS n_words FROM pages
""")
def site_file(spark, folder):
    """A config written from the pages' hosts and read back."""
    path = scratch(spark, "sites")
    hosts = table(spark, folder, "pages").select(site_key(F.col("url")).alias("site")).distinct()
    remove = F.struct(F.struct(F.array(F.lit("<b"), F.lit("("), F.lit(""), F.lit("^x")).alias("regex")).alias("remove"))
    sites = hosts.select(F.struct(
        F.concat(F.lit("d-"), "site").alias("name"), F.array(F.concat(F.lit("https://"), "site", F.lit("/a"))).alias("start_urls"),
        remove.alias("selectors"), F.struct(F.array(F.lit("a"), F.lit("b")).alias("require")).alias("tokenizer")).alias("s"))
    lists = sites.groupBy(F.pmod(F.xxhash64("s.name"), F.lit(16)).alias("part")).agg(F.to_json(F.collect_list("s")).alias("value"))
    lists.write.partitionBy("part").text(path)  # a list per file
    read = read_sites(spark, path)
    return read.select("site", "name", "removal_pattern", F.size("tokenizer.require").alias("n_words"))


@check(rf"""
WITH t AS (SELECT unnest({tokens_sql("text")}) AS term FROM benchmark)
SELECT 'en' AS lang, term, count(*) AS n FROM t GROUP BY term UNION ALL SELECT 'zh', '词' || n_nationkey, 1 FROM nation
""")
def stopword_files(spark, folder):
    """Word files with trailing blanks, empty lines and capitals, written from tables and read back."""
    path = scratch(spark, "words")
    terms = table(spark, folder, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    lines = terms.select(F.explode(F.array(F.concat(F.when(F.col("term").rlike("^[a-z]+$"), F.initcap("term")).otherwise(F.col("term")), F.lit("  ")), F.lit(" "))))
    lines.write.text(f"{path}/EnglishStopWords.txt")
    table(spark, folder, "nation").select(F.concat(F.lit("词"), "n_nationkey")).write.text(f"{path}/ChineseStopWords.txt")
    return read_stopwords(spark, path).groupBy("lang", "term").agg(F.count("*").alias("n"))
