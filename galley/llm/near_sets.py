"""One row of each group of near copies by the exact similarity of their five-word shingles.

Texts with the same set of shingles are one node; links are pairs of nodes whose sets have a Jaccard similarity of at
least ``percent`` hundredths, each verified on the whole sets; components of the links are groups of near copies.
SimHash proposes pairs by its keys of agreeing blocks, which number a few per fingerprint. It misses some pairs of
the similarity; those are found by the prefix filters of ``jaccard_join``, which lose none. Texts move only where a
node is not ruled out by shingles of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm import jaccard_join, simhash
from galley.llm.common import stored
from galley.operators.joins import small_broadcast

PERCENT, SHINGLE = 80, 5
NAME = ("near_sets_name_1", "near_sets_name_2")


def _proposed(radius: int, blocks: int, chunk: int):
    def pairs(found: DataFrame) -> DataFrame:
        held = found.filter("n > 0").select("node", "fp").distinct()
        heads = stored(held.groupBy("fp").agg(F.min("node").alias("b")), "heads")
        edges = simhash.near_edges(heads.select("fp"), radius, blocks, chunk)
        met = edges.join(heads.withColumnRenamed("b", "a"), "fp").select("a", F.col("least").alias("fp")).join(heads, "fp").select("a", "b")
        return met.unionByName(held.join(heads, "fp").select(F.col("node").alias("a"), "b")).filter("a != b")

    return pairs


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE,
                radius: int = 4, blocks: int = 6, chunk: int = simhash.CHUNK) -> DataFrame:
    """The rows of ``docs`` without near copies: of every component the row of least key stays, a null key last.

    Of rows that share a component's least key the one of least text hash stays, and of rows with equal keys and texts
    one. Texts without words are copies of one another. ``radius`` and ``blocks`` are those of SimHash's proposals.
    """
    found, roots = jaccard_join.linked_nodes(docs, key, text, shingle, percent, chunk=chunk, proposed=_proposed(radius, blocks, chunk),
                                             fp=lambda t: simhash.fingerprint(simhash.shingles(t, shingle)))
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "ROW1", "ROW2")
    names = found.groupBy("key", "ROW1", "ROW2", "node").agg(F.count("*").alias("rows")).join(roots, "node", "left")
    names = stored(names.select("ROW1", "ROW2", "rows", F.coalesce("root", "node").alias("root"), rank.alias("rank")), "names")
    kept = stored(names.groupBy("root").agg(F.min("rank").alias("rank")), "kept")
    met = names.join(kept.select(F.col("rank.ROW1").alias("ROW1"), F.col("rank.ROW2").alias("ROW2"), F.lit(True).alias("kept")),
                     ["ROW1", "ROW2"], "left")
    one, two = NAME
    met = stored(met.select(F.col("ROW1").alias(one), F.col("ROW2").alias(two), "rows", F.coalesce("kept", F.lit(False)).alias("kept")), "fates")
    # few rows go, and fewer repeat a key and a text: the texts of the others stay where they are
    gone, again = "NOT kept", "kept AND rows > 1"
    gone, again = (small_broadcast(met.filter(c).select(one, two)) for c in (f"{gone} OR ({again})", again))
    value = docs[text].cast("string")

    def named(other: DataFrame, how: str) -> DataFrame:
        return docs.join(other, (F.xxhash64(docs[key], value) == other[one]) & (F.hash(value, docs[key]) == other[two]), how)

    single = named(gone, "left_anti")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    repeated = named(again, "left_semi").select(row, F.xxhash64(docs[key], value).alias(one), F.hash(value, docs[key]).alias(two))
    return single.unionByName(repeated.dropDuplicates([one, two]).select("row.*"))
