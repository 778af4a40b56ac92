"""Text expressions: cleaning, tokens, sentences, n-grams and the predicates on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.bind import let

# Code point ranges that count as CJK.
CJK_CLASS = r"\x{4e00}-\x{9fa5}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}"

# Characters that cleaning keeps.
KEPT_CHARS = r"a-zA-Z0-9\x{4e00}-\x{9fa5}\s\-.'@#$%&*+/:;=?~(){}`_、。，《》？！“”‘’（）—…"

# Sentence ends in CJK text.
CJK_SENTENCE_END = r"[。！？.!?，；\x{3000}]"

# Keywords that are only punctuation, a number, a percentage or in scientific notation.
NOISE_KEYWORD = r"(?U)^[\W_]+$|^\d+(?:\.\d+)?%?$|^\d+[eE][+-]?\d+$"

_SENTENCE_MARK = "\u0001"


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK_CLASS}]")


def clean_text(text: Column, keep_accents: bool = False) -> Column:
    """Blank out every character outside the allow list. Accented letters are outside it by default."""
    kept = KEPT_CHARS + (r"\p{L}\p{M}" if keep_accents else "")
    return strip(F.regexp_replace(text, f"[^{kept}]", " "))


def strip(text: Column) -> Column:
    """Trim all white space, not blanks only."""
    return F.regexp_replace(text, r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", "")


def tokens(text: Column, min_chars: int = 2) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{%d,})" % min_chars), F.lit(1))


def drop_terms(terms: Column, stop: Iterable[str], required: Column | None = None) -> Column:
    """Remove a bounded list of stop words from a token array, keeping required words."""
    stop = sorted(set(stop))
    if not stop:
        return terms
    return F.filter(
        terms,
        lambda t: ~t.isin(stop) if required is None else (~t.isin(stop) | F.array_contains(required, t)),
    )


def ngrams(terms: Column, low: int = 1, high: int = 6) -> Column:
    """All n-grams of a token array, shortest first."""

    def of_length(words: Column, n: int) -> Column:
        # a guard, as counting up to less than the start would count down; elements are read one by
        # one, as a slice would copy the whole array for each n-gram
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(
            F.array().cast("array<int>")
        )
        return words if n == 1 else F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))

    if low == high == 1:
        return terms
    return let(terms, lambda words: F.concat(*[of_length(words, n) for n in range(low, high + 1)]))


def end_words(text: Column) -> Column:
    """Lower-cased words, without their last period, before places where a sentence may end by a single period."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+(?:\.\p{L}+)*)\.\s"), F.lit(1))


def sentences(text: Column, cjk: Column | None = None, abbreviations: Column | None = None) -> Column:
    """Sentence array; the rule follows the CJK flag, which is taken from the text by default.

    In Latin text no sentence ends behind a word of the array ``abbreviations``, in lower case and without its last period.
    """

    def join_behind_abbreviations(pieces: Column) -> Column:
        last = lambda p: F.regexp_extract(F.lower(p), r"(\p{L}+(?:\.\p{L}+)*)\.$", 1)
        mark = lambda p: F.when(F.array_contains(abbreviations, last(p)), "").otherwise(_SENTENCE_MARK)
        return F.split(F.array_join(F.transform(pieces, lambda p: F.concat(p, mark(p))), ""), _SENTENCE_MARK)

    def split(t: Column) -> Column:
        if abbreviations is None:
            latin = F.split(
                F.regexp_replace(t, r"([.!?]+[\"')\]]*)\s+", "$1" + _SENTENCE_MARK), _SENTENCE_MARK
            )
        else:  # white space stays before the next piece, as it may come to stand inside a sentence
            latin = join_behind_abbreviations(
                F.split(F.regexp_replace(t, r"([.!?]+[\"')\]]*)(\s+)", "$1" + _SENTENCE_MARK + "$2"), _SENTENCE_MARK))
        return F.when(has_cjk(t) if cjk is None else cjk, F.split(t, CJK_SENTENCE_END)).otherwise(latin)

    parts = let(text, split) if cjk is None else split(text)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def valid_keyword(term: Column) -> Column:
    return (F.length(term) >= 2) & ~term.rlike(NOISE_KEYWORD)


def valid_tag(tag: Column) -> Column:
    return tag.rlike(r"[\x{4e00}-\x{9fa5}a-zA-Z]")


def clean_title(title: Column) -> Column:
    """Strip white space, then any leading run of the characters of the label."""
    return F.ltrim(strip(title), F.lit("标题："))


def strip_leadin(text: Column) -> Column:
    """Remove an abstract's lead-in label and all that stands before it."""
    return F.regexp_replace(text, LEADIN, "")


# An abstract's lead-in label.
LEADIN = r"(?s)^.*?【?(?:本文|文章|本篇|全文|前言)\s*[，,]?\s*(?:简介|摘要|概述|导读|描述)】?[：:]?"


def split_tags(tags: Column) -> Column:
    """When any tag holds a bracket, split all tags at brackets and drop label and punctuation."""


    def split(all_tags: Column) -> Column:
        pieces = F.flatten(F.transform(all_tags, lambda t: F.filter(F.split(t, "[()]"), lambda x: x != "")))
        cleaned = F.transform(
            pieces,
            lambda x: strip(F.regexp_replace(F.replace(x, F.lit("标签："), F.lit("")), r"(?U)[^\w\s]", "")),
        )
        return F.when(F.exists(all_tags, lambda t: t.contains("(")), cleaned).otherwise(all_tags)

    return let(tags, split)


def tags_need_keywords(tags: Column) -> Column:
    """True when a page's own tags cannot be used: none, a label among them, or a tag with a blank."""
    return (
        tags.isNull()
        | (F.size(tags) == 0)
        | F.exists(tags, lambda t: t.startswith("标签："))
        | F.exists(tags, lambda t: t.contains(" "))
    )


def contains_any(text: Column, words: Column) -> Column:
    """True when any non-empty word of the array occurs in the text."""
    return F.exists(F.coalesce(words, F.array().cast("array<string>")), lambda w: (w != "") & text.contains(w))
