"""Image references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.bind import let
from galley.functions.urls import site_key, url_join

# Path names and parameters of image proxies, and hosts that refuse foreign pages.
PROXY_NAMES = ["img", "image", "link", "pic", "api"]
PROXY_PARAMS = ["url", "img", "image", "pic"]
HOTLINK_HOSTS = [
    ".baidu.com", ".byteimg.com", ".zhimg.com", "user-gold-cdn.xitu.io", "upload-images.jianshu.io",
    "img-blog.csdnimg.cn", "nimg.ws.126.net", ".360buyimg.com", ".sinaimg.cn",
    "user-images.githubusercontent.com", ".qhimg.com", ".alicdn.com", ".tbcdn.cn", ".cn.bing.net",
    ".sogoucdn.com", ".360tres.com",
]


def pick_source(src: Column, data_original: Column) -> Column:
    return F.coalesce(F.nullif(data_original, F.lit("")), src)


def is_real_image(src: Column, data_original: Column) -> Column:
    """Has a source, and that is not inline data."""
    return F.coalesce(src != "", F.lit(False)) & ~pick_source(src, data_original).contains("data:image/")


def unwrap_image_url(url: Column) -> Column:
    """The image behind a proxy link.

    Of the proxy prefixes the first in list order wins, wherever it stands in the URL; the result
    is what follows it up to its next occurrence.
    """

    def unwrap(u: Column) -> Column:
        result = u
        for name, param in reversed([(n, p) for n in PROXY_NAMES for p in PROXY_PARAMS]):
            prefix = f"/{name}.php?{param}="
            result = F.when(u.contains(prefix), F.split_part(u, F.lit(prefix), F.lit(2))).otherwise(result)
        return F.when(u.contains(".php?"), result).otherwise(u)

    return let(url, unwrap)


def is_hotlink_host(url: Column) -> Column:
    def listed(host: Column) -> Column:
        found = F.lit(False)
        for suffix in HOTLINK_HOSTS:
            found = found | host.endswith(suffix)
        return found

    return let(site_key(url), listed)


def real_url(page_url: Column, src: Column, data_original: Column) -> Column:
    return unwrap_image_url(url_join(page_url, pick_source(src, data_original)))


def image_filename(url: Column) -> Column:
    return F.concat(F.md5(url), F.lit(".jpg"))


def image_src(prefix: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.coalesce(prefix, F.lit("/images")), filename)
