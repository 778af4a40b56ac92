"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.bind import let

# Media types by file extension.
MEDIA_TYPES = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript",
    "json": "application/json", "xml": "text/xml", "txt": "text/plain", "csv": "text/csv",
    "pdf": "application/pdf", "zip": "application/zip",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml",
    "ico": "image/vnd.microsoft.icon", "tif": "image/tiff", "tiff": "image/tiff",
    "mp3": "audio/mpeg", "mp4": "video/mp4", "webm": "video/webm",
}

# scheme, authority, path, query, fragment of RFC 3986 appendix B
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, group)


def site_key(url: Column) -> Column:
    """Authority of a URL: user info, host and port."""
    return _part(url, 2)


def _remove_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments; a trailing one leaves a trailing slash."""
    walked = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, seg: F.when(seg == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(seg == ".", kept)
        .otherwise(F.concat(kept, F.array(seg))),
    )
    tail = F.when(path.rlike(r"(^|/)\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.concat(walked, tail), "/")).otherwise(path)


def _resolve(base: Column, ref: Column) -> Column:
    site = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))

    def with_path(path: Column) -> Column:
        folder = F.regexp_replace(_part(base, 3), r"[^/]*$", "")
        # repeated slashes inside the merged path collapse
        merged = F.regexp_replace(
            F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path), "/{2,}", "/")
        start = F.when(path.startswith("/"), F.regexp_replace(path, "(?<=.)/{2,}", "/")).otherwise(merged)
        rooted = let(
            let(start, _remove_dots),
            lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)),
        )
        return F.concat(site, rooted, F.regexp_extract(ref, r"(?s)([?#].*)$", 1))

    def without_path() -> Column:
        query = F.when(_part(ref, 4) != "", F.concat(F.lit("?"), _part(ref, 4))).when(
            base.contains("?"), F.concat(F.lit("?"), _part(base, 4))).otherwise("")
        return F.concat(site, _part(base, 3), query, F.regexp_extract(ref, r"(?s)(#.*)$", 1))

    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(_part(base, 1), F.lit(":"), ref))
        .otherwise(let(_part(ref, 3), lambda p: F.when(p == "", without_path()).otherwise(with_path(p))))
    )


def url_join(base: Column, href: Column) -> Column:
    """Resolve a link against the URL of the page it stands on."""
    ref = F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return let(F.struct(base.alias("base"), ref.alias("ref")), lambda x: _resolve(x["base"], x["ref"]))


def url_basename(url: Column) -> Column:
    """Last path segment, percent-decoded."""
    name = F.regexp_extract(_part(url, 3), r"([^/]*)/*$", 1)
    return let(name, lambda n: F.coalesce(F.try_url_decode(F.replace(n, F.lit("+"), F.lit("%2B"))), n))


def guess_media_type(url: Column) -> Column:
    """Media type by the extension of the last path segment, NULL when unknown."""
    extension = F.lower(F.regexp_extract(url_basename(url), r"[^.]\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(table, extension)
