"""Exact top-k inner products by MaxScore over sharded postings.

A vector's positive and negative components are terms of their own, ``(dimension, sign)``, so that every posting
has a non-negative weight and a bound. For a query a term whose sign agrees adds to the score, one whose
sign differs takes from it; the sum of the largest contributions of agreeing terms bounds a score from above.

Per shard, postings are held by blocks of documents, large vectors first. For each block the query's agreeing
terms are sorted by their bounds there; the longest run of least terms whose bounds together stay below the
query's threshold, its k-th best score so far, is non-essential: a document found in no other list cannot
enter the result. Essential terms are scored by a dense product over all lists of the block, the others at weight zero, so within
a block nothing is saved by their postings; blocks that cannot compete are skipped whole. Documents whose partial score plus the
bound of the rest is still competitive are probed in the other lists, and the disagreeing ones. Ties at the threshold
are probed too, so the result is exact, ties going to the smaller id.

The queries of a task pass the blocks together, so that their essential terms are one product of matrices; where whole numbers would not
be exact as doubles, one after the other.

A task searches one block of queries in one shard, both of bounded size and growing in number with the tables,
and only ``k`` rows per query and shard come back to be merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.common import stored

SHARD_ROWS, LEAST_SHARDS, QUERY_ROWS, BLOCK_ROWS = 20_000, 16, 2_048, 1_024
#: Queries that go through a shard's blocks together.
TOGETHER = 512
FOUND = "query_id BIGINT, vec_id BIGINT, score BIGINT"


def quantised(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of every component, as ``array<bigint>``."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    """True unless the vector is null or holds a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


class Postings:
    """A shard's posting lists by block of documents, for one sign of every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((ids, -np.abs(rows).sum(axis=1)))  # large vectors first: thresholds rise early
        self.ids, rows = ids[order], rows[order]
        self.blocks = []
        for at in range(0, len(rows), BLOCK_ROWS):
            part = rows[at:at + BLOCK_ROWS]
            lists = np.ascontiguousarray(np.concatenate([np.maximum(part, 0), np.maximum(-part, 0)], axis=1).T)
            self.blocks.append((self.ids[at:at + BLOCK_ROWS], lists, lists.max(axis=1, initial=0)))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best ids and scores of other documents: by score, then the smaller id."""
        signed = np.concatenate([query, -query])
        agree, differ = np.flatnonzero(signed > 0), np.flatnonzero(signed < 0)
        best_ids, best = np.empty(0, np.int64), np.empty(0, query.dtype)
        for ids, lists, most in self.blocks:
            full = len(best) >= k
            bounds = signed[agree] * most[agree]
            order = np.argsort(bounds, kind="stable")
            weak = np.searchsorted(np.cumsum(bounds[order]), best[-1], "left") if full else 0
            minor, major = agree[order[:weak]], agree[order[weak:]]
            if full and bounds.sum() < best[-1]:
                continue
            weights = np.zeros_like(signed)
            weights[major] = signed[major]
            partial = weights @ lists  # the lists of other terms weigh nothing; taking the essential ones out would copy them
            rest = signed[minor] @ most[minor]
            at = np.flatnonzero(partial + rest >= best[-1]) if full else np.arange(len(ids))
            if len(differ) and len(at):
                partial = partial[at] + signed[differ] @ lists[np.ix_(differ, at)]
                if full:  # what differs may already rule a document out
                    stay = partial + rest >= best[-1]
                    at, partial = at[stay], partial[stay]
            else:
                partial = partial[at]
            if weak and len(at):
                partial = partial + signed[minor] @ lists[np.ix_(minor, at)]
            new = ids[at]
            own = new != query_id
            best_ids, best = np.concatenate([best_ids, new[own]]), np.concatenate([best, partial[own]])
            if len(best) > k:
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
        top = np.lexsort((best_ids, -best))
        return best_ids[top], best[top]


    def search_many(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place of the query, id, score)`` of the same rows for many queries, whose components and scores are exact doubles.

        The essential terms of all queries that a block may serve are one product of matrices.
        """
        signed = np.concatenate([queries, -queries], axis=1)
        agree = np.maximum(signed, 0)
        floor = np.full(len(queries), -np.inf)  # the k-th best score so far
        place, best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for ids, lists, most in self.blocks:
            bounds = agree * most
            open_ = np.flatnonzero(bounds.sum(axis=1) >= floor)
            if not len(open_):
                continue
            bounds, least = bounds[open_], floor[open_, None]
            order = np.argsort(bounds, axis=1, kind="stable")
            weak = np.empty(bounds.shape, bool)
            np.put_along_axis(weak, order, np.cumsum(np.take_along_axis(bounds, order, 1), axis=1) < least, 1)
            major = np.where(weak, 0, agree[open_])
            rest = np.where(weak, bounds, 0).sum(axis=1, keepdims=True)
            partial, others = major @ lists, signed[open_] - major
            may = (partial + rest >= least) & (ids != query_ids[open_, None])
            if may.mean() > 0.02:  # probing so many documents one by one would copy their lists
                scores = np.where(may, partial + others @ lists, -np.inf)
                if len(ids) > k:
                    least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, [len(ids) - k]])
                q, at = np.nonzero(may & (scores >= least))
                new = scores[q, at]
            else:
                q, at = np.nonzero(may)
                new = partial[q, at] + np.einsum("ij,ij->i", others[q], lists.T[at])
            stay = new >= floor[open_[q]]
            q, at, new = q[stay], at[stay], new[stay]
            place, best_ids, best = np.concatenate([place, open_[q]]), np.concatenate([best_ids, ids[at]]), np.concatenate([best, new])
            order = np.lexsort((best_ids, -best, place))
            place, best_ids, best = place[order], best_ids[order], best[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place, "left")
            last = rank == k - 1
            floor[place[last]] = best[last]
            place, best_ids, best = place[rank < k], best_ids[rank < k], best[rank < k]
        return place, best_ids, best


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _search_shard(k: int):
    def run(key, queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(docs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims = max(docs["v"].map(len).max(), queries["v"].map(len).max(), 1)
        asked, rows = _matrix(queries["v"], dims), _matrix(docs["v"], dims)
        if float(np.abs(asked.astype(float)).max()) * float(np.abs(rows.astype(float)).max()) * dims < 1 << 52:
            asked, rows = asked.astype(float), rows.astype(float)  # exact below 2**53, and fast to multiply
            ids, found = queries["id"].to_numpy(np.int64), []
            postings = Postings(docs["id"].to_numpy(np.int64), rows)
            for at in range(0, len(ids), TOGETHER):
                place, best_ids, scores = postings.search_many(ids[at:at + TOGETHER], asked[at:at + TOGETHER], k)
                found.append(pd.DataFrame({"query_id": ids[at + place], "vec_id": best_ids, "score": scores.astype(np.int64)}))
            return pd.concat(found)
        postings = Postings(docs["id"].to_numpy(np.int64), rows)
        found = []
        for query_id, vector in zip(queries["id"].to_numpy(np.int64), asked):
            ids, scores = postings.search(query_id, vector, k)
            found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(found)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
          scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` largest inner products with all other rows.

    ``is_query`` is a condition on ``id``, the key. Components are quantised to whole numbers first. Null keys
    and vectors that are null or hold null or non-finite components take no part; a shorter vector counts as
    ending in zeros. Of rows with equal keys the least vector counts. Products beyond 64 bits wrap, as whole numbers do.
    """
    given = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    rows = given.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.min(quantised(F.col(vector), scale)).alias("v"))
    rows = stored(rows.withColumn("asked", F.coalesce(is_query, F.lit(False))), "vectors")
    total, asking = rows.agg(F.count("*"), F.count_if("asked")).first()
    shards = max(LEAST_SHARDS, -(-total // shard_rows))
    parts = max(1, -(-asking // QUERY_ROWS))
    docs = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "v")
    asked = rows.filter("asked").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v")
    found = asked.groupBy("shard", "part").cogroup(docs.groupBy("shard", "part")).applyInPandas(_search_shard(k), FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
