"""Article fields from shredded pages.

Every step is row-local: ``tree`` holds ``(page_id, url, site, nodes, rule)`` with the site's rule as
a struct, so all sites run in one plan whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import dates, dom, images
from galley.functions import text as T
from galley.functions.bind import compute_once
from galley.functions.frontmatter import watermark
from galley.operators.filters import filter_titles, filter_words, require_fields
from galley.operators.joins import small_broadcast

def _nodes() -> Column:
    return F.col("nodes")


def with_rules(tree: DataFrame, sites: DataFrame) -> DataFrame:
    """Attach each page's site rule; pages of unknown sites are no concern of ours."""
    article = F.col("selectors.article")
    steps = F.struct(
        *[dom.selector_steps(article[name]).alias(name) for name in ("title", "tags", "excerpt", "content", "date")],
        F.transform_values(article["extras"], lambda _, s: dom.selector_steps(s)).alias("extras"),
        dom.selector_list_steps(F.col("selectors.remove.tags")).alias("remove"),
        dom.selector_steps(F.col("selectors.list.article")).alias("links"),
        dom.selector_steps(F.col("selectors.list.next")).alias("next"),
    )
    # selectors are split once per site, here, and not once per page
    rules = sites.select("site", F.struct(*[c for c in sites.columns if c != "site"]).alias("rule"), steps.alias("steps"))
    return tree.join(small_broadcast(rules, 50_000), "site")


def with_title(tree: DataFrame) -> DataFrame:
    title = T.clean_title(dom.node_text(_nodes(), dom.first_step_match(_nodes(), F.col("steps.title"))))
    return require_fields(compute_once(tree, title=title), "title")


def with_content(tree: DataFrame) -> DataFrame:
    """``root`` is the content element; articles without one are dropped."""
    found = require_fields(compute_once(tree, root=dom.first_step_match(_nodes(), F.col("steps.content"))), "root")
    found = compute_once(found, _raw_text=dom.node_text(_nodes(), F.col("root")))
    return filter_words(found, "_raw_text").drop("_raw_text")


def clean_content(tree: DataFrame) -> DataFrame:
    """Lead-in label, unwanted elements and unwanted text nodes go, in that order."""
    root = F.col("root")
    tree = tree.withColumn("nodes", dom.strip_leadin_block(_nodes(), root))
    tree = tree.withColumn("nodes", dom.drop_matches(_nodes(), F.col("steps.remove"), root))
    return tree.withColumn("nodes", dom.drop_text_matching(_nodes(), F.col("rule.removal_pattern"), root))


def choose_excerpt(
    by_selector: Column, by_meta: Column, paragraphs: Column, by_ranking: Column | None = None, least: int = 60
) -> Column:
    """Excerpt by the first source that applies.

    Selector text, else the page's description, else its first paragraph (the second if the first is
    empty) when longer than ``least``, else nothing. Only an article without such paragraphs falls
    to the ranked sentences, which are NULL here until they are known.
    """
    first = F.try_element_at(paragraphs, F.lit(1))
    paragraph = F.when(first != "", first).otherwise(F.coalesce(F.try_element_at(paragraphs, F.lit(2)), F.lit("")))
    by_ranking = F.lit(None).cast("string") if by_ranking is None else by_ranking
    return F.coalesce(
        by_selector,
        by_meta,
        F.when(F.size(paragraphs) > 0, F.when(F.length(paragraph) > least, paragraph).otherwise("")),
        by_ranking,
    )


def with_excerpt(tree: DataFrame) -> DataFrame:
    selected = T.strip(dom.node_text(_nodes(), dom.first_step_match(_nodes(), F.col("steps.excerpt"))))
    paragraphs = dom.texts(_nodes(), dom.plain_paragraphs(_nodes(), F.col("root")))
    return tree.withColumn(
        "excerpt", choose_excerpt(selected, dom.meta_content(_nodes(), "description"), paragraphs)
    )


def choose_tags(
    extract: Column, selected: Column, meta: Column, keywords: Column, has_selector: Column
) -> Column:
    """Tags by the first source that applies.

    With ``extract`` the keywords; else the selected tags, or the page's meta keywords where the
    site has no tag selector; keywords again where these cannot be used. Tags without a letter go.
    """
    own = T.split_tags(F.when(has_selector, selected).otherwise(meta))
    chosen = F.when(T.tags_need_keywords(own), keywords).otherwise(own)
    return F.when(F.coalesce(extract, F.lit(False)), keywords).otherwise(F.filter(chosen, T.valid_tag))


def with_own_tags(tree: DataFrame) -> DataFrame:
    """``own_tags`` from the page, and ``needs_keywords`` where they do not serve."""
    has_selector = F.coalesce(T.strip(F.col("rule.selectors.article.tags")) != "", F.lit(False))
    blank = F.array().cast("array<string>")
    selected = F.filter(F.transform(dom.texts(_nodes(), dom.select_steps(_nodes(), F.col("steps.tags"))), T.strip), lambda t: t != "")
    meta = F.filter(F.transform(F.split(dom.meta_content(_nodes(), "keywords"), ","), T.strip), lambda t: t != "")
    own = T.split_tags(F.when(has_selector, F.coalesce(selected, blank)).otherwise(F.coalesce(meta, blank)))
    tree = tree.withColumn("own_tags", own)
    return tree.withColumn(
        "needs_keywords", F.coalesce(F.col("rule.extract"), F.lit(False)) | T.tags_need_keywords(F.col("own_tags"))
    )


def extract_extras(tree: DataFrame) -> DataFrame:
    """One entry per configured selector; what is not found is 0."""
    values = F.transform_values(
        F.col("steps.extras"),
        lambda _, s: F.coalesce(dom.node_text(_nodes(), dom.first_step_match(_nodes(), s)), F.lit("0")),
    )
    return tree.withColumn("extras", F.coalesce(values, F.create_map().cast("map<string,string>")))


def with_pubdate(tree: DataFrame, as_of: Column) -> DataFrame:
    written = dom.node_text(_nodes(), dom.first_step_match(_nodes(), F.col("steps.date")))
    return tree.withColumn("date", dates.pubdate_or(dates.parse_pubdate(written), as_of))


def with_images(tree: DataFrame) -> DataFrame:
    """Rewrite the kept images of the content; ``images`` is their manifest, ``pictures`` the sources."""
    tree = tree.withColumn("nodes", dom.unwrap_pictures(_nodes(), F.col("root")))

    def entry(pre: Column) -> Column:
        attrs = F.get(_nodes(), pre)["attrs"]
        src = F.coalesce(F.try_element_at(attrs, F.lit("src")), F.lit(""))
        original = F.coalesce(F.try_element_at(attrs, F.lit("data-original")), F.lit(""))
        return F.struct(
            pre.alias("pre"), src.alias("src"), original.alias("data_original"),
            images.real_url(F.col("url"), src, original).alias("real_url"),
        )

    found = F.transform(dom.select(_nodes(), "img", F.col("root")), entry)
    tree = tree.withColumn(
        "images",
        F.filter(found, lambda i: images.is_real_image(i["src"], i["data_original"]) & ~images.is_hotlink_host(i["real_url"])),
    )
    prefix = F.col("rule.imgprefix")
    tree = tree.withColumn(
        "images",
        F.transform(
            "images",
            lambda i, pos: F.struct(
                i["pre"].alias("pre"), pos.alias("pos"), i["real_url"].alias("real_url"),
                images.image_filename(i["real_url"]).alias("filename"),
                images.image_src(prefix, images.image_filename(i["real_url"])).alias("new_src"),
            ),
        ),
    )
    tree = tree.withColumn("nodes", dom.rewrite_images(_nodes(), F.col("images"), F.col("title")))
    return tree.withColumn("pictures", thumbs(_nodes(), F.col("root")))


def thumbs(nodes: Column, root: Column) -> Column:
    """Distinct image sources of a subtree, sorted so that reruns agree."""
    return F.sort_array(F.array_distinct(
        F.transform(dom.select(nodes, "img[src]", root), lambda p: dom.attribute_of(nodes, p, "src"))))


def render_content(tree: DataFrame) -> DataFrame:
    """``content`` (HTML), ``markdown`` and ``content_text``; the node array ends here.

    The site's watermark goes in after the last element of the content.
    """
    root = F.col("root")
    mark = watermark(F.coalesce(F.col("rule.watermark.text"), F.lit("")))
    return tree.select(
        *[c for c in tree.columns if c not in ("nodes", "root", "steps")],
        dom.node_text(_nodes(), root).alias("content_text"),
        dom.to_html(_nodes(), root, mark).alias("content"),
        dom.to_markdown(_nodes(), root, mark).alias("markdown"),
    )


def parse_articles(tree: DataFrame, as_of: Column) -> DataFrame:
    """All row-local fields of an article; cheap rejections come first."""
    parsed = filter_words(filter_titles(with_title(tree)), "title")
    parsed = clean_content(with_content(parsed))
    parsed = with_own_tags(with_excerpt(parsed))
    parsed = with_images(with_pubdate(extract_extras(parsed), as_of))
    return render_content(parsed)


def image_manifest(parsed: DataFrame) -> DataFrame:
    """One row per kept image, for a downstream fetcher."""
    # the outer form: a plain explode would first filter by size and copy the images' whole expression
    rows = parsed.select("site", "page_id", F.explode_outer("images").alias("i")).filter("i IS NOT NULL")
    return rows.select(
        "site", "page_id", "i.pos", "i.real_url", "i.filename", "i.new_src"
    )
