"""The whole job: discover links, parse pending pages, write documents, update state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import dom
from galley.functions import text as T
from galley.functions.urls import site_key, url_join
from galley.operators import abbreviations as abbr
from galley.operators import articles as A
from galley.operators import frontier, phrases
from galley.operators.documents import build_documents
from galley.operators.excerpt import excerpt_bm25
from galley.operators.joins import small_broadcast
from galley.operators.keywords import article_keywords, keyword_arrays
from galley.operators.segment import segmenter, transliterate
from galley.operators.shred import shred
from galley.session import cut_lineage

@dataclass
class Result:
    """Tables a run yields."""

    articles: DataFrame
    documents: DataFrame
    images: DataFrame
    parsed: DataFrame


def stop_set(stopwords: DataFrame | None, lang: str) -> list[str]:
    """The stop words of a language as plain values, for a set in the plan: a list is configuration, not data.

    Words without a language, and those of a table without languages, hold for all.
    """
    if stopwords is None:
        return []
    if "lang" in stopwords.columns:
        stopwords = stopwords.filter((F.col("lang") == lang) | F.col("lang").isNull())
    return [r[0] for r in stopwords.select(F.lower("term")).distinct().collect()]


def listing_hosts(sites: DataFrame) -> DataFrame:
    """``(site, host)``: a page belongs to the sites that start on its host."""
    own = sites.select("site", F.explode("start_urls").alias("start")).select("site", site_key(F.col("start")).alias("host"))
    return own.unionByName(sites.select("site", F.col("site").alias("host"))).distinct()


def start_listings(sites: DataFrame) -> DataFrame:
    return sites.select("site", F.explode("start_urls").alias("url"))


def listing_tree(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``(site, url, links, next_url)`` of every page as a listing of the sites on its host, links resolved."""
    hosts = small_broadcast(listing_hosts(sites), 50_000)
    placed = shred(pages).withColumn("host", site_key(F.col("url"))).join(hosts, "host").drop("host")
    tree = A.with_rules(placed, sites)
    nodes = F.col("nodes")
    # links are all that is needed of a listing, so they are kept and not its nodes
    tree = cut_lineage(tree.select(
        "url", "site",
        dom.attributes(nodes, dom.select_steps(nodes, F.col("steps.links")), "href").alias("hrefs"),
        dom.attribute_of(nodes, dom.first_step_match(nodes, F.col("steps.next")), "href").alias("next_href"),
    ))
    return tree.select(
        "site", "url", F.transform("hrefs", lambda href: url_join(F.col("url"), href)).alias("links"),
        F.when(F.col("next_href").isNotNull(), url_join(F.col("url"), F.col("next_href"))).alias("next_url"))


def listing_links(pages: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Article links of the listings reached from each site's start URLs, and those listings."""
    tree = listing_tree(pages, sites)
    edges = tree.filter("next_url IS NOT NULL").select("url", "next_url")
    listings = frontier.reachable_listings(edges, start_listings(sites))
    links = tree.join(listings.select("site", "url"), ["site", "url"], "left_semi")
    return links.select("site", F.explode("links").alias("url")), listings


def complete_articles(
    parsed: DataFrame,
    stopwords: DataFrame | None = None,
    dictionary: DataFrame | list[str] | None = None,
    syllables: DataFrame | None = None,
    phrase_scores: DataFrame | None = None,
    phrase_vectors: DataFrame | bool | None = None,
    abbreviations: DataFrame | bool | None = None,
) -> DataFrame:
    """Fill in what needs the whole text or the whole corpus: keywords, ranked excerpts, slug source.

    With ``phrase_vectors``, ``(term, vec)`` or true for vectors trained on the articles at hand, texts without CJK characters
    are ranked by diverse phrases; those with them, and all without it, by n-gram weights over the corpus.
    With ``abbreviations``, ``(term, n)`` or true for those that the articles show, no sentence of an excerpt ends behind one.
    """
    segment = segmenter(parsed.sparkSession, dictionary)
    latin_stop, cjk_stop = stop_set(stopwords, "en"), stop_set(stopwords, "zh")
    required = F.coalesce(F.col("rule.tokenizer.require"), F.array().cast("array<string>"))
    site_stop = F.transform(F.coalesce(F.col("rule.tokenizer.filter"), F.array().cast("array<string>")), F.lower)
    texts = parsed.filter("needs_keywords").select(
        "url", T.clean_text(F.col("content_text")).alias("body"), T.has_cjk(F.col("content_text")).alias("cjk"),
        F.transform(required, F.lower).alias("required"), site_stop.alias("site_stop"),
    )
    # CJK tokens are cut by dictionary; the tokens of both kinds lose their stop words before the n-grams
    latin = T.tokens(F.col("body"))
    cjk = F.filter(
        T.drop_terms(segment(F.when(F.col("cjk"), F.col("body"))), cjk_stop, F.col("required")),
        lambda t: ~F.array_contains(F.col("site_stop"), t) | F.array_contains(F.col("required"), t),
    )
    texts = texts.withColumn("terms", F.when(F.col("cjk"), cjk).otherwise(
        F.filter(T.drop_terms(latin, latin_stop, F.col("required")),
                 lambda t: ~F.array_contains(F.col("site_stop"), t) | F.array_contains(F.col("required"), t))))
    texts = cut_lineage(texts.select("url", "cjk", "terms", "required"))
    if phrase_vectors is None or phrase_vectors is False:
        ranked = article_keywords(texts.drop("cjk"), F.col("terms"), "url", "required", phrase_scores=phrase_scores)
    else:
        by_phrase, others = (texts.filter(c).drop("cjk") for c in ("NOT cjk", "cjk"))
        vectors = phrases.word_vectors(by_phrase, "terms") if phrase_vectors is True else phrase_vectors
        found = cut_lineage(phrases.phrase_scores(by_phrase, vectors, "terms", "url").drop("rank"))
        ranked = article_keywords(by_phrase, F.col("terms"), "url", "required", phrase_scores=found).unionByName(
            article_keywords(others, F.col("terms"), "url", "required"))
    keywords = keyword_arrays(ranked)

    sentence_terms = F.when(
        T.has_cjk(F.col("sentence")), T.drop_terms(segment(F.when(T.has_cjk(F.col("sentence")), F.col("sentence"))), cjk_stop)
    ).otherwise(T.drop_terms(T.tokens(F.col("sentence"), 1), latin_stop))
    no_excerpt, known = parsed.filter("excerpt IS NULL").select("url", "content_text"), None
    if abbreviations is not None and abbreviations is not False:
        listed = abbr.abbreviations(parsed, "content_text") if abbreviations is True else abbreviations
        no_excerpt, known = cut_lineage(abbr.with_abbreviations(no_excerpt, "content_text", listed, "url")), F.col("abbreviations")
    excerpts = excerpt_bm25(no_excerpt, "content_text", 5, "url", terms=sentence_terms, abbreviations=known).withColumnRenamed("excerpt", "ranked")

    rows = parsed.join(keywords, "url", "left").join(excerpts, "url", "left")
    none = F.array().cast("array<string>")
    found = F.coalesce("keywords", none)
    rows = rows.withColumn("excerpt", F.coalesce("excerpt", "ranked", F.lit(""))).withColumn(
        "tags",
        F.when(F.coalesce(F.col("rule.extract"), F.lit(False)), found).otherwise(
            F.filter(F.when(F.col("needs_keywords"), found).otherwise(F.col("own_tags")), T.valid_tag)),
    )
    if syllables is None:
        return rows.withColumn("slug_source", F.col("title"))
    titles = parsed.select("url", "title").filter(T.has_cjk(F.col("title")))
    spoken = transliterate(titles, "title", syllables, "url")
    return rows.join(spoken, "url", "left").withColumn("slug_source", F.coalesce("syllables", "title"))


def pending_pages(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """Pages of the pending articles, each with the site of its state row, whatever its own host is.

    A URL that several sites list belongs to the first by name. Of several pages with one URL the one of least
    ``page_id`` counts; that is settled on URLs and ids, before any markup moves.
    """
    todo = articles.filter("publish = false").groupBy("url").agg(F.min("site").alias("site"))
    chosen = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).join(todo, "url")
    chosen = chosen.select("url", "page_id", F.coalesce("site", site_key(F.col("url"))).alias("site"))
    return pages.drop("site").join(chosen, ["url", "page_id"])


def process_pages(pages: DataFrame, sites: DataFrame, articles: DataFrame, as_of, **inputs) -> Result:
    """Parse the pages that are pending in ``articles`` and update their rows."""
    tree = A.with_rules(shred(pending_pages(pages, articles)), sites)
    # every later part reads these rows, and parsing them costs most
    parsed = cut_lineage(A.parse_articles(tree, as_of))
    done = cut_lineage(complete_articles(parsed, **inputs))
    documents = build_documents(done)
    written = done.join(documents.filter("n_bytes > 0").select("url"), "url", "left_semi")
    return Result(frontier.apply_parsed(articles, written), documents, A.image_manifest(done), done)


def run(
    spark: SparkSession, sites: DataFrame, pages: DataFrame, articles: DataFrame, as_of, discover: bool = True,
    **inputs: DataFrame | list[str] | None,
) -> Result:
    """One pass over all sites. ``as_of`` is the instant for pages without a readable date.

    ``inputs``: ``stopwords``, ``dictionary``, ``syllables``, ``phrase_scores``, ``phrase_vectors``,
    ``abbreviations`` — language resources are tables, none is built in; the last two can be learned from the pages.
    """
    if discover:
        links, _ = listing_links(pages, sites)
        articles = frontier.add_discovered(articles, links)
    return process_pages(pages, sites, articles, as_of, **inputs)
