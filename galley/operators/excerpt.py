"""Extractive excerpts by BM25 sentence centrality."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.functions.bind import compute_once
from galley.operators.joins import spread, text_bytes

# The usual BM25 constants.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Tokens that are scored together in a task.
SLICE_TOKENS = 1 << 18


def _score_slice(lists):
    """Scores of the sentences of documents, each a list of sentences' token arrays."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sents = lists.flatten()
    per_doc = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    lens = pc.fill_null(pc.list_value_length(sents), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc_of = np.repeat(np.arange(len(lists)), per_doc)
    known = sents.flatten().cast(pa.string()).dictionary_encode()
    codes, base = pc.fill_null(known.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), max(len(known.dictionary), 1)
    sent = np.repeat(np.arange(len(sents)), lens)
    number, tf = np.unique((sent * base + codes)[codes >= 0], return_counts=True)  # a null token has length and no weight
    sent, code = number // base, number % base
    doc = doc_of[sent]
    own, at = np.unique(doc * base + code, return_inverse=True)  # a document's terms
    owner = own // base
    avg_len = np.bincount(doc, tf, len(lists)) / np.maximum(per_doc, 1)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[sent] / avg_len[doc]))
    mass, n_t = np.bincount(at, part, len(own)), np.bincount(at, minlength=len(own))
    raw = np.log(per_doc[owner] - n_t + 0.5) - np.log(n_t + 0.5)
    mean = np.bincount(owner, raw, len(lists)) / np.maximum(np.bincount(owner, minlength=len(lists)), 1)
    idf = np.where(raw < 0, EPSILON * mean[owner], raw)
    scores = np.bincount(sent, tf * idf[at] * mass[at] / per_doc[doc], len(sents))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_doc)).astype(np.int32)), pa.array(scores, pa.float64()))


def _scores(lists: Column) -> Column:
    @F.arrow_udf("array<double>")
    def scored(lists):
        import pyarrow as pa
        import pyarrow.compute as pc

        per_sent = pc.fill_null(pc.list_value_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        slices = np.cumsum(np.bincount(doc, per_sent, len(lists))) // SLICE_TOKENS
        cuts = np.append(np.flatnonzero(np.diff(slices, prepend=-1)), len(lists)).tolist()
        return pa.concat_arrays([_score_slice(lists.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])] or [_score_slice(lists)])

    return scored(lists)


def bm25_sentences(
    docs: DataFrame,
    text: str,
    key: str = "doc_id",
    stop: Iterable[str] = (),
    terms: Column | None = None,
    abbreviations: Column | None = None,
) -> DataFrame:
    """``(key, sent_no, score)``: mean BM25 of each sentence as a query against all.

    A sentence's score is the sum over its tokens of M(t) = idf(t)/N · Σ_j tf-part(t, j), so no pair
    of sentences is ever formed: the work is linear in the tokens, after one shuffle of the texts.
    ``terms`` may replace the tokens of a sentence (an expression on the column ``sentence``).
    ``abbreviations`` is an array of each row behind which no sentence ends.
    A document of one row is scored in its row, by the numbers of its tokens; with ``terms``, or several rows of a key, tokens are rows.
    """
    if terms is not None:
        return _bm25_rows(spread(docs, key), text, key, terms, abbreviations)
    words = lambda s: T.drop_terms(T.tokens(s, 1), stop)
    placed = spread(docs, key, text_bytes(docs, key)).withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy(key)))
    split = T.sentences(F.col(text), abbreviations=abbreviations)
    alone = compute_once(placed.filter("_rows = 1"), _words=F.transform(split, words)).filter("_words IS NOT NULL")
    alone = alone.select(key, F.posexplode(_scores(F.col("_words"))).alias("sent_no", "score"))
    return alone.unionByName(_bm25_rows(placed.filter("_rows > 1"), text, key, words(F.col("sentence")), abbreviations))


def _bm25_rows(placed: DataFrame, text: str, key: str, terms: Column, abbreviations: Column | None) -> DataFrame:
    split = (
        placed
        .select(key, T.sentences(F.col(text), abbreviations=abbreviations).alias("_sents"))
        .select(key, F.size("_sents").alias("n_sents"), F.posexplode("_sents").alias("sent_no", "sentence"))
        .select(key, "n_sents", "sent_no", terms.alias("_terms"))
        .withColumn("len", F.size("_terms"))
    )
    doc = W.partitionBy(key)
    rows = (
        split.select(key, "n_sents", "sent_no", "len", F.explode_outer("_terms").alias("term"))
        .groupBy(key, "n_sents", "sent_no", "len", "term").agg(F.count("term").alias("tf"))
        # every (sentence, term) row stands for tf tokens of the document
        .withColumn("avg_len", F.sum("tf").over(doc) / F.col("n_sents"))
    )
    one = W.partitionBy(key, "term")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    rows = rows.withColumn("n_t", F.count("term").over(one)).withColumn("mass", F.sum(F.when(F.col("term").isNotNull(), part)).over(one))
    raw = F.ln(F.col("n_sents") - F.col("n_t") + 0.5) - F.ln(F.col("n_t") + 0.5)
    share = F.when(F.col("n_t") > 0, 1.0 / F.col("n_t"))
    rows = rows.withColumn("raw", F.when(F.col("term").isNotNull(), raw)).withColumn(
        "mean_idf", F.sum(F.col("raw") * share).over(doc) / F.sum(share).over(doc)
    )
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return rows.groupBy(key, "sent_no").agg(
        F.coalesce(F.sum(F.col("tf") * idf * F.col("mass") / F.col("n_sents")), F.lit(0.0)).alias("score")
    )


def excerpt_bm25(
    docs: DataFrame, text: str, k: int = 3, key: str = "doc_id", stop: Iterable[str] = (), terms: Column | None = None,
    abbreviations: Column | None = None,
) -> DataFrame:
    """``(key, excerpt)``: the ``k`` most central sentences in text order, joined by a blank.

    Of equal scores the later sentence goes first.
    """
    order = W.partitionBy(key).orderBy(F.desc(F.round("score", 9)), F.desc("sent_no"))
    best = (
        bm25_sentences(docs, text, key, stop, terms, abbreviations)
        .withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
        .groupBy(key).agg(F.sort_array(F.collect_list("sent_no")).alias("_best"))
    )
    # only places travel through the scoring; the sentences are cut from the text again at the end
    sents = T.sentences(F.col(text), abbreviations=abbreviations)
    return (
        docs.select(key, sents.alias("_sents")).join(best, key)
        .select(key, F.array_join(F.transform("_best", lambda i: F.get("_sents", i)), " ").alias("excerpt"))
    )
