"""Keywords of articles: n-gram weight times corpus weight, with required words forced in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.operators.joins import BROADCAST_ROWS, HOT_ROWS, lookup_join
from galley.operators.scoring import boost_required, gram_counts, merge_required, rank_keywords, term_idf, tf_l2
from galley.session import cut_lineage, written_once


def article_keywords(
    docs: DataFrame,
    terms: Column,
    key: str = "url",
    required: str | None = None,
    k: int = 500,
    phrase_scores: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Ranked keywords per document: ``(key, term, score, rank)``.

    ``terms`` yields the token array of a row, ``required`` names a column with the words to force
    in. Scores are the n-gram's weight in its document times a second weight: that of
    ``phrase_scores`` ``(key, term, score)`` where given (keyphrases from vectors), else tf·idf over
    the corpus for single terms, the best ``k`` per document.
    """
    # every n-gram counts for the norm; without phrases, rows are needed of single terms and of required ones alone
    counts = gram_counts(docs, terms, key, most=None if phrase_scores is not None else 1)
    grams = tf_l2(counts, key).withColumnRenamed("gram", "term")
    if phrase_scores is None:
        single = grams = written_once(grams.filter("n = 1"))
        idf = cut_lineage(term_idf(single.select("term"), docs.select(F.count("*")).scalar()))
        total = F.sum("tf").over(W.partitionBy(key))
        scored = lookup_join(single.withColumn("total", total), idf, "term", "df", broadcast_rows, hot_rows)
        scored = scored.withColumn("second", F.col("tf") / F.col("total") * F.col("idf"))
        place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("second"), "term"))
        scored = scored.withColumn("_place", place).filter(F.col("_place") <= k)
    else:
        grams = written_once(grams)
        scored = grams.join(phrase_scores.select(key, "term", F.col("score").alias("second")), [key, "term"])
    scores = scored.select(key, "term", (F.col("weight") * F.col("second")).alias("score"))
    if required is not None:
        wanted = written_once(docs.select(key, F.explode(required).alias("term")).filter("term != ''").distinct())
        longer = wanted.filter("contains(term, ' ')").select(key).distinct()
        if phrase_scores is None and not longer.isEmpty():
            several = tf_l2(gram_counts(docs.join(longer, key, "left_semi"), terms, key), key).withColumnRenamed("gram", "term")
            grams = grams.unionByName(several.filter("n > 1"))
        scores = written_once(scores)
        scores = boost_required(merge_required(scores, grams, wanted, key), wanted, key)
    return rank_keywords(scores, key)


def keyword_arrays(ranked: DataFrame, key: str = "url", keep: int | None = None) -> DataFrame:
    """``(key, keywords)`` in rank order."""
    if keep is not None:
        ranked = ranked.filter(F.col("rank") <= keep)
    return ranked.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords")
    )


def cleaned_terms(text: Column, stop: list[str], required: Column | None = None) -> Column:
    """Tokens of cleaned text without stop words."""
    return T.drop_terms(T.tokens(T.clean_text(text)), stop, required)
