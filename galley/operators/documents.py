"""Published documents: front matter plus Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import frontmatter as fm
from galley.functions.dates import date_digits, fmt_pubdate
from galley.functions.slugs import slugify

def base_fields(
    title: Column, date: Column, tags: Column, excerpt: Column, categories: Column, author: Column,
    pictures: Column, slug: Column,
) -> dict[str, Column]:
    """The front matter's fields, fixed names in fixed order, as TOML values. A site without an author has an empty one."""
    top = fm.toml_array(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 5))
    yes, no = F.lit("true"), F.lit("false")
    return {
        "title": fm.toml_string(title), "date": fm.toml_string(date), "tags": top, "keywords": top,
        "description": fm.toml_string(F.coalesce(excerpt, F.lit(""))),
        "categories": fm.toml_array(categories),
        "author": fm.toml_string(F.coalesce(author, F.lit(""))), "cover": fm.toml_string(F.lit("")),
        "pictures": fm.toml_array(pictures), "hiddenFromHomePage": no, "readingTime": yes,
        "hideComments": yes, "isCJKLanguage": yes, "slug": fm.toml_string(slug),
    }


def front_matter(lines: Column, cms: Column) -> Column:
    """YAML block for the one system that wants it, TOML for all others."""
    return F.when(cms == "hexo", fm.as_yaml(lines)).otherwise(fm.as_toml(lines))


def doc_name(date: Column, url: Column) -> Column:
    """Stable per URL, so that a rerun overwrites its document."""
    return F.concat(date_digits(date), F.lit("-"), F.md5(url), F.lit(".md"))


def render_document(block: Column, markdown: Column) -> Column:
    return F.concat(block, F.lit("\n\n"), markdown)


def build_documents(parsed: DataFrame) -> DataFrame:
    """``(site, url, doc_name, body, n_bytes)`` from complete parsed rows.

    ``slug_source`` is the title, with syllables in place of CJK characters where these are known.
    """
    rule = F.col("rule")
    slug = slugify(
        F.col("slug_source"), rule["slugify"]["separator"], rule["slugify"]["stopwords"],
        rule["slugify"]["replacements"],
    )
    rows = parsed.withColumn("_date", fmt_pubdate(F.col("date"))).withColumn("_slug", slug)
    fields = base_fields(
        F.col("title"), F.col("_date"), F.col("tags"), F.col("excerpt"), rule["categories"], rule["author"],
        F.col("pictures"), F.col("_slug"),
    )
    rows = rows.withColumn("_lines", fm.front_matter_lines(fields, F.col("extras")))
    rows = rows.select(
        "site", "url", doc_name(F.col("_date"), F.col("url")).alias("doc_name"),
        render_document(front_matter(F.col("_lines"), rule["cms"]), F.col("markdown")).alias("body"),
    )
    return rows.withColumn("n_bytes", F.octet_length("body"))
