"""Titles, dates, slugs, extras, watermarks and image references over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.checks.registry import H1, check, sql_list, table
from galley.functions import dates, frontmatter, images, slugs
from galley.functions import text as T


@check("""
SELECT doc_id, ltrim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN '  标题：' || lang || ' ' WHEN 1 THEN '标题：题目：' || source ELSE lang || '标题' END,
  '^\\s+|\\s+$', '', 'g'), '标题：') AS title FROM documents
""".replace("\\\\", "\\"))
def clean_titles(spark, folder):
    raw = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  标题："), "lang", F.lit(" ")))
           .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("标题：题目："), "source")).otherwise(F.concat("lang", F.lit("标题"))))
    return table(spark, folder, "documents").select("doc_id", T.clean_title(raw).alias("title"))


@check("SELECT doc_id, '：' || source AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1")
def leadin_text(spark, folder):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("前文\n【本文， 简介】：："), "source")).otherwise(F.col("source"))
    return table(spark, folder, "documents").select("doc_id", T.strip_leadin(raw).alias("text"))


DATE_FORMS = """
  f AS (SELECT event_id, ts, event_id % 8 AS k FROM events),
  w AS (SELECT event_id, CASE k
      WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('minute', ts)
      WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('second', ts) END - INTERVAL 8 HOUR AS t FROM f)
"""


def _dates(spark, folder):
    ts = F.col("ts")

    def fmt(pattern):
        return F.date_format(ts, pattern)

    half = F.when(F.hour(ts) < 12, F.lit("上午")).otherwise(F.lit("下午"))
    western = F.when(F.hour(ts) < 12, F.lit("AM")).otherwise(F.lit("PM"))
    k = F.col("event_id") % 8
    raw = (
        F.when(k == 0, F.concat(F.lit("发布于 "), fmt("yyyy年M月d日 HH:mm")))
        .when(k == 1, F.concat(fmt("yyyy年M月d日 "), half, fmt("h:mm")))
        .when(k == 2, F.concat(fmt("yyyy-MM-dd h:mm"), western))
        .when(k == 3, fmt("yyyy/M/d HH:mm:ss"))
        .when(k == 4, fmt("yyyy MM dd HH:mm"))
        .when(k == 5, F.concat(fmt("yyyy.MM.dd h:mm:ss"), half))
        .when(k == 6, fmt("MM-dd HH:mm"))
        .otherwise(fmt("yyyy年13月d日 HH:mm"))
    )
    return table(spark, folder, "events").select("event_id", raw.alias("raw"))


@check(f"WITH {DATE_FORMS} SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS instant FROM w")
def date_parse(spark, folder):
    rows = _dates(spark, folder)
    instant = F.convert_timezone(None, F.lit("UTC"), dates.parse_pubdate(F.col("raw")))
    return rows.select("event_id", F.date_format(instant, "yyyy-MM-dd HH:mm:ss").alias("instant"))


@check(f"""
WITH {DATE_FORMS}, d AS (SELECT event_id, strftime(coalesce(t, TIMESTAMP '2024-05-06 07:08:09') + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+0800' AS written FROM w)
SELECT event_id, written, regexp_replace(written, '[^0-9]', '', 'g') AS digits FROM d
""")
def date_default(spark, folder):
    as_of = F.to_timestamp(F.lit("2024-05-06 07:08:09+00:00"))
    rows = _dates(spark, folder).select("event_id", dates.fmt_pubdate(
        dates.pubdate_or(dates.parse_pubdate(F.col("raw")), as_of)).alias("written"))
    return rows.withColumn("digits", dates.date_digits(F.col("written")))


@check(r"""
WITH s AS (SELECT page_id, regexp_replace(lower(strip_accents(replace(regexp_replace(""" + H1 + r""", '''+', '-', 'g'), 'ß', 'ss'))), '[^a-z0-9]+', '-', 'g') AS slug FROM pages)
SELECT page_id, trim(slug, '-') AS slug, array_to_string(list_filter(string_split(trim(slug, '-'), '-'), lambda w: w NOT IN ('the', 'de', 'a')), '_') AS short FROM s
""")
def slug_titles(spark, folder):
    title = F.replace(F.replace(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    pages = table(spark, folder, "pages").select("page_id", title.alias("title"))
    return pages.select("page_id", slugs.slugify(F.col("title")).alias("slug"),
                        slugs.slugify(F.col("title"), "_", ["The", "de", "a"]).alias("short"))


@check("""
SELECT n_nationkey AS id, array_to_string(list_transform(string_split(n_name || '中é', ''), lambda c: lpad(CAST(unicode(c) AS VARCHAR), CAST(greatest(3, length(CAST(unicode(c) AS VARCHAR))) AS INTEGER), '0')), chr(8203)) AS mark FROM nation
UNION ALL SELECT 1000 + doc_id, array_to_string(list_transform(string_split(source, ''), lambda c: lpad(CAST(unicode(c) AS VARCHAR), 3, '0')), chr(8203)) FROM documents
""")
def watermark_codes(spark, folder):
    names = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat("n_name", F.lit("中é")).alias("t"))
    docs = table(spark, folder, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("source").alias("t"))
    return names.unionByName(docs).select("id", frontmatter.watermark(F.col("t")).alias("mark"))


@check("""
WITH e AS (SELECT p_partkey, p_size, p_name, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'a \\"' || p_name || '\\" \\\\b' ELSE '' END AS value,
  CASE WHEN k < 2 THEN CAST(p_size AS BIGINT) ELSE -1 END AS value_int FROM e
""")
def extras_normalise(spark, folder):
    k = F.col("p_partkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit(" （"), "p_size", F.lit("） "))).when(k == 1, F.concat(F.lit("00"), "p_size"))
           .when(k == 2, F.concat(F.lit('(a "'), "p_name", F.lit('" \\b)'))).otherwise(F.lit(" () ")))
    rows = table(spark, folder, "part").select("p_partkey", F.create_map(F.lit("x"), raw).alias("extras"))
    return rows.select("p_partkey", frontmatter.normalise_extras(F.col("extras"))["x"].alias("value"),
                       F.coalesce(frontmatter.extra_int(F.col("extras")["x"]), F.lit(-1)).alias("value_int"))


NAMES, PARAMS = images.PROXY_NAMES, images.PROXY_PARAMS


@check(f"""
WITH p AS (SELECT page_id, url, [{sql_list(NAMES)}][page_id % 5 + 1] AS n, [{sql_list(PARAMS)}][page_id % 4 + 1] AS q FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN url ELSE 'http://z/' END AS link,
  md5(url) || '.jpg' AS filename, '/images/' || md5(url) || '.jpg' AS new_src FROM p
""")
def image_links(spark, folder):
    pages = table(spark, folder, "pages")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("page_id") % 5 + 1).cast("int"))
    param = F.element_at(F.array(*[F.lit(q) for q in PARAMS]), (F.col("page_id") % 4 + 1).cast("int"))
    prefix = F.concat(F.lit("/"), name, F.lit(".php?"), param, F.lit("="))
    link = (
        F.when(F.col("page_id") % 3 == 0, F.col("url"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://p.example.net"), prefix, "url", prefix, F.lit("tail")))
        # the first prefix of the list wins, not the first in the link
        .otherwise(F.lit("http://a/api.php?pic=http://y/img.php?url=http://z/"))
    )
    file = images.image_filename(F.col("url"))
    return pages.select("page_id", images.unwrap_image_url(link).alias("link"), file.alias("filename"),
                        images.image_src(F.lit(None).cast("string"), file).alias("new_src"))


@check(f"""
WITH h AS (SELECT [{sql_list(images.HOTLINK_HOSTS)}] AS hosts),
  i AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://' || page_id || hosts[page_id % 16 + 1] || '/a.png'
     WHEN 2 THEN 'data:image/png;base64,' || page_id WHEN 3 THEN '' ELSE 'https://h.example.org/' || page_id || '.alicdn.com' END AS src FROM pages, h)
SELECT page_id, src FROM i WHERE page_id % 5 IN (0, 4)
""")
def kept_images(spark, folder):
    pages = table(spark, folder, "pages")
    hosts = F.array(*[F.lit(h) for h in images.HOTLINK_HOSTS])
    k = F.col("page_id") % 5
    src = (F.when(k == 0, F.col("url"))
           .when(k == 1, F.concat(F.lit("https://"), "page_id", F.element_at(hosts, (F.col("page_id") % 16 + 1).cast("int")), F.lit("/a.png")))
           .when(k == 2, F.concat(F.lit("data:image/png;base64,"), "page_id")).when(k == 3, F.lit(""))
           .otherwise(F.concat(F.lit("https://h.example.org/"), "page_id", F.lit(".alicdn.com"))))
    rows = pages.select("page_id", src.alias("src"))
    return rows.filter(images.is_real_image(F.col("src"), F.lit("")) & ~images.is_hotlink_host(F.col("src")))
