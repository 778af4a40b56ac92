"""Abbreviations learned from the corpus, so that a sentence does not end at "Dr. ".

The measure is that of Kiss and Strunk (2006): the log-likelihood that a word and the period behind it belong together, times
factors for short words, inner periods and uses without a period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.operators.joins import lookup_join
from galley.session import cut_lineage

# The published share of periods behind an abbreviation, and the score from which a word is one.
TOGETHER, THRESHOLD = 0.99, 0.3

#: Words of letters, with inner periods, and the period behind them if there is one.
WORDS = r"(\p{L}+(?:\.\p{L}+)*\.?)"


def abbreviation_scores(docs: DataFrame, text: str) -> DataFrame:
    """``(term, with_period, without, score)`` of every word that has a period behind it somewhere, without that period.

    Words are folded by task before they meet; null texts have none.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(1))).alias("w"))
    ended = F.endswith("w", F.lit("."))
    types = cut_lineage(words.groupBy(F.rtrim(F.col("w"), F.lit(".")).alias("term")).agg(
        F.count_if(ended).alias("with_period"), F.count_if(~ended).alias("without")))
    n, periods = types.agg(F.sum(F.col("with_period") + F.col("without")), F.sum("with_period")).first()
    chance = min(max((periods or 0) / (n or 1), 1e-9), 1 - 1e-9)
    c, o = F.col("with_period"), F.col("without")
    likely = c * (F.ln(F.lit(TOGETHER)) - F.ln(F.lit(chance))) + o * (F.ln(F.lit(1 - TOGETHER)) - F.ln(F.lit(1 - chance)))
    letters = F.length(F.replace("term", F.lit("."), F.lit("")))
    inner = F.length("term") - letters
    score = 2 * likely * F.exp(-letters) * (inner + 1) * F.pow(letters, -o)
    return types.filter("with_period > 0").select("term", "with_period", "without", score.alias("score"))


def abbreviations(docs: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(term, n)``: the words that the corpus shows to be abbreviations, with their uses."""
    return abbreviation_scores(docs, text).filter(F.col("score") >= threshold).select("term", F.col("with_period").alias("n"))


def with_abbreviations(docs: DataFrame, text: str, listed: DataFrame, key: str, name: str = "abbreviations") -> DataFrame:
    """``docs`` with an array of the listed abbreviations ``(term, n)`` that stand at possible sentence ends of each text.

    The words at such places meet the list, of any size, in a join that stands skew; what a row gets is bounded by its own
    text. ``key`` is unique; a null key or text gets an empty array.
    """
    ends = docs.select(key, F.explode(F.array_distinct(T.end_words(F.col(text)))).alias("term"))
    met = lookup_join(ends, listed, "term", "n").groupBy(key).agg(F.collect_set("term").alias(name))
    return docs.join(met, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
