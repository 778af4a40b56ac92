"""Keyphrases of documents from word vectors trained on the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.session import cut_lineage

#: Words that get a vector at most, the most frequent; tokens that one partition of the training takes at least.
WORDS, PARTITION_TOKENS = 100_000, 1_000_000
#: Words of documents that are ranked together.
PART_TOKENS = 200_000


def word_vectors(docs: DataFrame, terms: str, dims: int = 64, min_count: int = 2, words: int = WORDS, seed: int = 42) -> DataFrame:
    """``(term, vec)`` trained on the token arrays of a column.

    The vocabulary holds words of at least ``min_count`` occurrences, and of more if there are more than ``words`` of them, since
    the trainer keeps one vector per word on every executor. Null and empty arrays teach nothing; a corpus without words of
    that count has no vectors.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    texts = docs.select(F.col(terms).alias("terms")).filter(F.size("terms") > 0)
    counts = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))  # a row per different count
    total, least, held = 0, None, 0
    for row in by_count.toLocalIterator():
        total += row["n"] * row["words"]
        if row["n"] >= min_count and held + row["words"] <= words:
            held, least = held + row["words"], row["n"]
    if least is None:
        return docs.sparkSession.createDataFrame([], "term STRING, vec ARRAY<DOUBLE>")
    parts = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, total // PARTITION_TOKENS))
    model = Word2Vec(vectorSize=dims, minCount=least, seed=seed, numPartitions=parts, inputCol="terms", outputCol="vec").fit(texts)
    return model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vec"))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=-1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def diverse_phrases(terms: list[str], vectors: np.ndarray, k: int, diversity: float, longest: int) -> list[tuple[str, float, int]]:
    """``k`` phrases of up to ``longest`` words by maximal marginal relevance: ``(phrase, score, rank)``.

    A phrase's vector is the mean of its words', the document's the mean of all. Of equal values the phrase first in the
    alphabet wins; values are compared to nine digits.
    """
    sums = np.concatenate([np.zeros((1, vectors.shape[1])), vectors.cumsum(axis=0)])
    places = {" ".join(terms[i:i + n]): (i, n) for n in range(1, longest + 1) for i in range(len(terms) - n + 1)}
    names = sorted(places)
    at, n = np.array([places[p] for p in names]).T
    rows = unit_rows((sums[at + n] - sums[at]) / n[:, None])
    score = rows @ unit_rows(vectors.mean(axis=0))
    value, near, out = score.copy(), np.full(len(names), -np.inf), []
    for rank in range(1, min(k, len(names)) + 1):
        best = int(np.round(value, 9).argmax())
        out.append((names[best], float(score[best]), rank))
        near = np.maximum(near, rows @ rows[best])
        value = (1 - diversity) * score - diversity * near
        value[[names.index(p) for p, *_ in out]] = -np.inf
    return out


def _best_phrases(k: int, diversity: float, longest: int):
    def run(part, docs, vectors):
        import pandas as pd

        size = max((len(v) for v in vectors["vec"]), default=1)
        matrix = np.zeros((len(vectors) + 1, size))
        for i, vec in enumerate(vectors["vec"], 1):
            matrix[i, :len(vec)] = vec
        places = {term: i for i, term in enumerate(vectors["term"], 1)}
        row, found = [], []
        for name, tokens in zip(docs["row"], docs["tokens"]):
            tokens = [t for t in tokens if t is not None]
            at = [places.get(t, 0) for t in tokens]
            new = diverse_phrases(tokens, matrix[at], k, diversity, longest) if any(at) else []
            row += [name] * len(new)
            found += new
        return pd.DataFrame({"row": row, "term": [f[0] for f in found], "score": [f[1] for f in found], "rank": [f[2] for f in found]})

    return run


def phrase_scores(docs: DataFrame, vectors: DataFrame, terms: Column | str, key: str = "doc_id", k: int = 5, diversity: float = 0.5,
                  longest: int = 6, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``(key, term, score, rank)``: each document's diverse phrases of one to ``longest`` words from ``vectors (term, vec)``.

    Words without a vector count as zero; documents without words, or of which none has a vector, get no phrase. Of several
    vectors of a word the least counts. Documents are dealt to parts of about ``part_tokens`` words, and a part gets the vectors
    of its own words: no n-gram is shuffled, and vectors may be of any number.
    """
    table = vectors.filter("term IS NOT NULL AND vec IS NOT NULL").groupBy("term").agg(F.min("vec").alias("vec"))
    tokens = F.col(terms) if isinstance(terms, str) else terms
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key, tokens.alias("tokens"))
    rows = cut_lineage(rows.filter(F.size("tokens") > 0))  # rows keep their numbers; keys may repeat
    total = rows.agg(F.sum(F.size("tokens"))).first()[0] or 0
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-total // part_tokens)))))
    known = rows.select(F.col("part").alias("own"), F.explode("tokens").alias("term")).distinct().join(table, "term").select("own", "term", "vec")
    found = rows.select("part", "row", "tokens").groupBy("part").cogroup(known.groupBy("own")).applyInPandas(
        _best_phrases(k, diversity, longest), "row BIGINT, term STRING, score DOUBLE, rank INT")
    return rows.select("row", key).join(found, "row").select(key, "term", "score", "rank")
