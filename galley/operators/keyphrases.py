"""Diverse keyphrases from supplied vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.functions.bind import compute_once, let
from galley.operators.joins import spread


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(vec: Column) -> Column:
    """Vector of length one, as doubles."""
    sized = let(vec.cast("array<double>"), lambda v: F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm")))
    return let(
        sized, lambda s: F.when(s["norm"] > 0, F.transform(s["v"], lambda x: x / s["norm"])).otherwise(s["v"])
    )


def keyphrases_mmr(
    candidates: DataFrame, doc_vectors: DataFrame, k: int = 5, diversity: float = 0.5, key: str = "doc_id"
) -> DataFrame:
    """``k`` phrases per document by maximal marginal relevance: ``(key, term, score, rank)``.

    ``candidates`` is ``(key, term, vec)`` with one row per phrase, ``doc_vectors`` ``(key, vec)``;
    ``score`` is the phrase's cosine to the document. Every round is a window over the document on
    the same partitioning and order, so all rounds together need the one shuffle by document.
    """
    doc = W.partitionBy(key)
    # vectors are the bulk of the rows: so many partitions that a task's share does not grow with the table
    longest = doc_vectors.agg(F.max(F.size("vec"))).first()[0] or 1
    size = candidates.count() * 2 * 8 * max(longest, 1)
    candidates, doc_vectors = spread(candidates, key, size), spread(doc_vectors, key, size)
    rows = (
        compute_once(candidates.select(key, "term", "vec"), vec=unit(F.col("vec")))
        .join(compute_once(doc_vectors.select(key, "vec"), _doc=unit(F.col("vec"))).drop("vec"), key)
        .select(key, "term", "vec", dot(F.col("vec"), F.col("_doc")).alias("score"))
        .withColumn("rank", F.lit(None).cast("int"))
        .withColumn("_near", F.lit(None).cast("double"))
    )
    for place in range(1, k + 1):
        value = F.when(
            F.col("rank").isNull(),
            F.round(
                F.col("score") if place == 1
                else (1 - diversity) * F.col("score") - diversity * F.col("_near"), 9
            ),
        )
        # of equal values the phrase first in the alphabet wins: min_by on the negated value
        best = F.min_by(F.struct("term", "vec"), F.when(value.isNotNull(), F.struct((-value).alias("v"), F.col("term")))).over(doc)
        rows = rows.withColumn("_best", best)
        rows = rows.withColumn("rank", F.when(F.col("rank").isNull() & (F.col("term") == F.col("_best.term")), place).otherwise(F.col("rank")))
        if place < k:
            near = dot(F.col("vec"), F.col("_best.vec"))
            rows = rows.withColumn("_near", F.when(F.col("rank").isNull(), F.greatest("_near", near)))
    return rows.filter("rank IS NOT NULL").select(key, "term", "score", "rank")
