"""Filters on articles and large block lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions.text import contains_any
from galley.operators.blocklist import mark_blocked


def filter_titles(parsed: DataFrame, titles: str = "rule.selectors.filter.titles", on: str = "title") -> DataFrame:
    """Drop articles whose title holds any blocked fragment."""
    return parsed.filter(~contains_any(F.col(on), F.col(titles)))


def filter_words(parsed: DataFrame, on: str, words: str = "rule.selectors.filter.words") -> DataFrame:
    """Drop articles whose column holds any blocked word."""
    return parsed.filter(~contains_any(F.col(on), F.col(words)))


def require_fields(parsed: DataFrame, *names: str) -> DataFrame:
    """Drop articles that lack a required node."""
    return parsed.dropna(subset=list(names))


def blocked_ids(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Keys of the rows whose text holds any phrase, for lists too long to test one by one."""
    return mark_blocked(df.select(key, text), text, phrases, phrase, "_blocked").filter("_blocked").select(key).distinct()


def drop_blocked(df: DataFrame, text: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Drop the rows whose text holds any phrase of a long list."""
    return mark_blocked(df, text, phrases, phrase, "_blocked").filter("NOT _blocked").drop("_blocked")
