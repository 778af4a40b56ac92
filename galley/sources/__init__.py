"""Tables in and out."""

from galley.sources.readers import (
    default_stopwords,
    read_articles,
    read_documents,
    read_html_files,
    read_pages,
    read_sites,
    read_stopwords,
    stopword_table,
)
from galley.sources.writers import (
    compact_articles,
    encode_nested,
    write_articles,
    write_documents,
    write_image_manifest,
)

__all__ = [
    "compact_articles", "default_stopwords", "encode_nested", "read_articles", "read_documents", "read_html_files",
    "read_pages", "read_sites", "read_stopwords", "stopword_table", "write_articles",
    "write_documents", "write_image_manifest",
]
