"""Readers with fixed schemas."""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.text import strip
from galley.functions.urls import site_key
from galley.schemas import ARTICLES, PAGES, SITE_FILE

LANGUAGE_NAMES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
# File names of the stop-word lists, by language.
STOPWORD_FILES = {"en": "EnglishStopWords.txt", "zh": "ChineseStopWords.txt"}


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site rules from a JSON array, with the site key of the first start URL."""
    sites = spark.read.schema(SITE_FILE).json(path, multiLine=True)
    return with_removal_pattern(sites.withColumn("site", site_key(F.get("start_urls", 0))))


def with_removal_pattern(sites: DataFrame) -> DataFrame:
    """Add one pattern per site that matches text at its start; invalid expressions are left out."""
    numbered = sites.withColumn("_id", F.struct("site", F.xxhash64(F.to_json(F.struct("selectors")))))
    listed = numbered.select("_id", F.posexplode("selectors.remove.regex").alias("_at", "_p")).filter("_p != ''")
    # null where the pattern does not compile: it is ignored, as a site's fault
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("_p"))
    good = listed.distinct().withColumn("_ok", compiled).filter("_ok IS NOT NULL").groupBy("_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "_p"))), lambda x: x["_p"]).alias("_kept"))
    sites = numbered.join(good, "_id", "left").drop("_id")
    kept = F.coalesce("_kept", F.array().cast("array<string>"))
    pattern = F.when(F.size(kept) > 0, F.concat(F.lit("^(?:"), F.array_join(
        F.transform(kept, lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|"), F.lit(")")))
    return sites.withColumn("removal_pattern", F.coalesce(pattern, F.lit(""))).drop("_kept")


def read_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    """``(lang, term)`` from one file per language; a missing file gives no terms."""
    parts = []
    for lang, name in STOPWORD_FILES.items():
        try:
            lines = spark.read.text(os.path.join(folder, name))
        except AnalysisException:
            continue
        parts.append(lines.select(F.lit(lang).alias("lang"), F.lower(strip(F.col("value"))).alias("term")))
    if not parts:
        return spark.createDataFrame([], "lang STRING, term STRING")
    terms = parts[0]
    for part in parts[1:]:
        terms = terms.unionByName(part)
    return terms.filter("term != ''")


def default_stopwords(lang: str) -> list[str]:
    """Built-in list of a language; there is none for Chinese."""
    name = LANGUAGE_NAMES.get(lang)
    return sorted(StopWordsRemover.loadDefaultStopWords(name)) if name else []


def stopword_table(
    spark: SparkSession, langs: list[str], files: DataFrame | None = None, site_terms: DataFrame | None = None
) -> DataFrame:
    """Union of built-in, file and site stop words, lower-cased and distinct."""
    rows = [(lang, term) for lang in langs for term in default_stopwords(lang)]
    table = spark.createDataFrame(rows, "lang STRING, term STRING")
    for extra in (files, site_terms):
        if extra is not None:
            table = table.unionByName(extra.select("lang", "term"))
    return table.select("lang", F.lower("term").alias("term")).distinct()


def _usable(pages: DataFrame, html: Column) -> DataFrame:
    return pages.withColumn("html", strip(html)).filter(F.coalesce(F.col("html") != "", F.lit(False)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages; those that failed or are empty are skipped."""
    return _usable(spark.read.schema(PAGES).parquet(path), F.col("html"))


#: Byte order marks and the charset that each stands for; fixed values.
MARKS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
#: Labels that stand for a larger charset on the web; fixed values.
WIDER = {"gb2312": "gb18030", "gbk": "gb18030", "gb_2312-80": "gb18030", "x-gbk": "gb18030", "iso-8859-1": "windows-1252",
         "latin1": "windows-1252", "us-ascii": "windows-1252", "ascii": "windows-1252", "shift_jis": "cp932", "utf-16": "utf-8",
         "utf-16le": "utf-8", "utf-16be": "utf-8"}
DECLARED = re.compile(rb"""<meta[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)
LOOKED_AT = 1024


def decode_bytes(data: bytes, default: str = "utf-8") -> str:
    """A page's text: by its byte order mark, else the charset that a ``meta`` near its beginning names, else the default.

    What a charset cannot read becomes U+FFFD; an unknown label counts as none. A page that names UTF-16 in readable ASCII is not
    written in it, and counts as UTF-8.
    """
    for mark, charset in MARKS.items():
        if data.startswith(mark):
            return data[len(mark):].decode(charset, "replace")
    found = DECLARED.search(data, 0, LOOKED_AT)
    label = found[1].decode("ascii").lower() if found else default
    try:
        return data.decode(WIDER.get(label, label), "replace")
    except LookupError:
        return data.decode(default, "replace")


def decode_html(content: Column, default: str = "utf-8") -> Column:
    """Bytes of pages to text. Pages that are UTF-8 and say nothing else stay in the JVM."""

    @F.pandas_udf("string")
    def decoded(pages):
        return pages.map(lambda page: None if page is None else decode_bytes(bytes(page), default))

    head = F.lower(F.decode(F.substring(content, 1, LOOKED_AT), "ISO-8859-1"))
    named = F.regexp_extract(head, r"""<meta[^>]*?charset\s*=\s*["']?\s*([a-z0-9_:.-]+)""", 1)
    marked = head.startswith("\xff\xfe".lower()) | head.startswith("\xfe\xff".lower()) | head.startswith("\xef\xbb\xbf".lower())
    plain = ~marked & (named.isin("utf-8", "utf8") | ((named == "") & F.lit(default == "utf-8")))
    return F.when(plain, content.cast("string")).otherwise(decoded(F.when(~plain, content)))


def read_html_files(spark: SparkSession, path: str, url_prefix: str = "https://", charset: str = "utf-8") -> DataFrame:
    """Pages from saved HTML files; the path below the folder is the rest of the URL. ``charset`` is that of pages that name none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = os.path.basename(path.rstrip("/"))
    url = F.concat(F.lit(url_prefix), F.regexp_extract("path", f"/{root}/(.*)$", 1))
    pages = files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), decode_html(F.col("content"), charset).alias("html"))
    return _usable(pages, F.col("html"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(site, doc_name, body, n_bytes)``: of a document written in several batches, the last."""
    rows = spark.read.schema("site STRING, doc_name STRING, body STRING, n_bytes INT, batch BIGINT").option(
        "basePath", path).parquet(path)
    return rows.groupBy("site", "doc_name").agg(F.max_by(F.struct("body", "n_bytes"), "batch").alias("row")).select(
        "site", "doc_name", "row.*")


def compacted_batch(spark: SparkSession, path: str) -> int | None:
    """The last batch that a finished compaction of the store took in, by its pointers."""
    try:
        return spark.read.schema("upto BIGINT").json(f"{path}/_versions/upto=*").agg(F.max("upto")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def article_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store that count, with their batch: the last compacted version and the batches behind it.

    A version counts from when its pointer stands, which is written last; batches up to it are not looked at, so they can go.
    """
    schema = ARTICLES + ", batch BIGINT"
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    upto = compacted_batch(spark, path)
    if upto is None:
        return rows
    base = spark.read.schema(schema).option("basePath", f"{path}/_base").parquet(f"{path}/_base/batch={upto}")
    return base.unionByName(rows.filter(F.col("batch") > upto))


def read_articles(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Latest state per URL.

    The store is a folder per batch, each holding the rows that batch changed. Reading few columns
    (the guards need ``url`` and ``publish`` only) keeps content out of the scan and the shuffle.
    """
    fields = [c for c in (columns or spark.createDataFrame([], ARTICLES).columns) if c != "url"]
    rows = article_rows(spark, path)
    if fields == ["publish"]:
        return rows.groupBy("url").agg(F.max_by("publish", "batch").alias("publish"))
    latest = rows.groupBy("url").agg(F.max_by(F.struct(*fields), "batch").alias("row"))
    return latest.select("url", "row.*")
