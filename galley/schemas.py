"""Table schemas. Given explicitly: inference on empty arrays and maps yields unusable types."""

from __future__ import annotations

PAGES = "page_id BIGINT, url STRING, html STRING"

SITE_FILE = """
  name STRING, start_urls ARRAY<STRING>,
  selectors STRUCT<
    list: STRUCT<article: STRING, next: STRING>,
    article: STRUCT<title: STRING, tags: STRING, excerpt: STRING, content: STRING, date: STRING,
                    extras: MAP<STRING, STRING>>,
    remove: STRUCT<tags: ARRAY<STRING>, regex: ARRAY<STRING>>,
    filter: STRUCT<titles: ARRAY<STRING>, words: ARRAY<STRING>>>,
  cms STRING, categories ARRAY<STRING>, author STRING, imgprefix STRING, extract BOOLEAN,
  watermark STRUCT<text: STRING, password: STRING>,
  slugify STRUCT<stopwords: ARRAY<STRING>, replacements: ARRAY<ARRAY<STRING>>, separator: STRING>,
  tokenizer STRUCT<filter: ARRAY<STRING>, `require`: ARRAY<STRING>>
"""

ARTICLES = """
  url STRING, title STRING, tags ARRAY<STRING>, excerpt STRING, content STRING, date TIMESTAMP,
  extras MAP<STRING, STRING>, pictures ARRAY<STRING>, publish BOOLEAN, site STRING
"""

# The fields an article's parsed record overwrites.
PARSED_FIELDS = ["title", "tags", "excerpt", "content", "date", "extras", "pictures"]

# One element of the node array of a page. `pre` is the node's place in document order and its
# index in the array; `post` is the largest `pre` in its subtree, so a subtree is a slice.
NODE = """STRUCT<pre: INT, post: INT, parent: INT, depth: INT, kind: STRING, tag: STRING,
  classes: ARRAY<STRING>, attrs: MAP<STRING, STRING>, text: STRING>"""
