"""Front matter and documents over the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from galley.checks.registry import check, table
from galley.checks.texts import page_fields
from galley.checks.registry import ARTICLE, H1, decode_sql
from galley.functions import frontmatter as fm
from galley.functions.slugs import slugify
from galley.functions.urls import site_key
from galley.operators import documents as D

QUOTED = """'"' || replace(replace({0}, '\\', '\\\\'), '"', '\\"') || '"'"""
FIELDS = f"""
  f AS (SELECT page_id, url, {H1} AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site,
      trim(regexp_replace(lower(strip_accents(replace(regexp_replace({H1}, '''+', '-', 'g'), 'ß', 'ss'))), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
      regexp_extract_all(lower({H1}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM pages),
  v AS (SELECT *, '"2024-01-01T08:00:00+0800"' AS d, w[1:5] AS tags FROM f),
  t AS (SELECT *, '[' || array_to_string(list_transform(tags, lambda x: '"' || x || '"'), ', ') || ']' AS tl FROM v)
"""
TOML = f"""
'title = ' || {QUOTED.format("title")} || chr(10) || 'date = ' || d || chr(10) || 'tags = ' || tl || chr(10) || 'keywords = ' || tl || chr(10) ||
'description = ""' || chr(10) || 'categories = ["news", "a b"]' || chr(10) || 'author = ' || CASE WHEN page_id % 2 = 0 THEN '""' ELSE {QUOTED.format("site")} END || chr(10) ||
'cover = "override"' || chr(10) || 'pictures = []' || chr(10) || 'hiddenFromHomePage = false' || chr(10) || 'readingTime = true' || chr(10) ||
'hideComments = true' || chr(10) || 'isCJKLanguage = true' || chr(10) || 'slug = "' || slug || '"' || chr(10) ||
'views = ' || page_id || chr(10) || '"浏 览" = "x\\\\\\"y"' || chr(10) || 'draft = false'
"""


def _lines(spark, folder):
    rows = page_fields(spark, folder)
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    extras = F.create_map(F.lit("cover"), F.lit("override"), F.lit("views"), F.concat(F.lit("（"), "page_id", F.lit("）")),
                          F.lit("浏 览"), F.lit('x"y'), )
    author = F.when(F.col("page_id") % 2 == 0, F.lit("")).otherwise(site_key(F.col("url")))
    fields = D.base_fields(
        F.col("title"), F.lit("2024-01-01T08:00:00+0800"), words, F.lit(None).cast("string"),
        F.array(F.lit("news"), F.lit("a b")), author, F.array().cast("array<string>"), slugify(F.col("title")))
    return rows.select("page_id", "url", "body", fm.front_matter_lines(fields, extras).alias("lines"))


@check(f"WITH {FIELDS} SELECT page_id, '+++' || chr(10) || {TOML} || chr(10) || '+++' AS block FROM t")
def front_matter_toml(spark, folder):
    return _lines(spark, folder).select("page_id", D.front_matter(F.col("lines"), F.lit("hugo")).alias("block"))


@check(rf"""
WITH {FIELDS},
  y AS (SELECT page_id, list_transform(string_split({TOML}, chr(10)), lambda l: [regexp_extract(l, '^(.*?) = (.*)$', 1), regexp_extract(l, '^(.*?) = (.*)$', 2)]) AS kv FROM t)
SELECT page_id, '---' || chr(10) || array_to_string(list_transform(kv, lambda e: CASE WHEN starts_with(e[2], '[') AND ends_with(e[2], ']')
  THEN e[1] || ':' || array_to_string(list_transform(list_filter(list_transform(string_split(e[2][2:-2], ','), lambda i: trim(trim(i), '"''')), lambda i: i <> ''),
    lambda i: chr(10) || '  - ' || i), '')
  ELSE e[1] || ': ' || trim(e[2], '"') END), chr(10)) || chr(10) || '---' AS block FROM y
""")
def front_matter_yaml(spark, folder):
    return _lines(spark, folder).select("page_id", D.front_matter(F.col("lines"), F.lit("hexo")).alias("block"))


@check(f"""
WITH {FIELDS}, b AS (SELECT page_id, {ARTICLE.replace("'<[^>]*>', ''", "'<[^>]*>', ' '")} AS body FROM pages)
SELECT page_id, '20240101080000800-' || md5(url) || '.md' AS doc_name, md5('+++' || chr(10) || {TOML} || chr(10) || '+++' || chr(10) || chr(10) || body) AS digest
FROM t JOIN b USING (page_id)
""".replace("20240101080000800", "202401010800000800"))
def rendered_documents(spark, folder):
    body = D.render_document(D.front_matter(F.col("lines"), F.lit("hugo")), F.col("body"))
    return _lines(spark, folder).select("page_id", D.doc_name(F.lit("2024-01-01T08:00:00+0800"), F.col("url")).alias("doc_name"),
                                        F.md5(body).alias("digest"))
