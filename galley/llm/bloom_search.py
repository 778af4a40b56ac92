"""Ranked lexical search by bit-sliced Bloom signatures.

A document's distinct terms, and with them the fact that a term occurs at least 2 or 4 times, set a few bits each of a
signature whose length is a power of two near the number of those facts times ``BITS``. Documents of one length are dealt
to shards, and a shard's signatures are turned into slices: one bitmap over its documents for each place of a signature. The
AND of a term's slices holds every document that has the term, and some more.

For a query the slices of its terms, weighted, are summed for each of the levels of occurrence. With a document's own length
that sum gives an upper bound of its score: a term seen at a level counts as often as the level allows. Documents of the
highest bounds are scored exactly from their texts first; the k-th best score so found is a threshold, and every document
whose bound reaches it is scored exactly. So the result is exact whatever the slices overestimate.

The vocabulary with its document frequencies, and the number of documents and terms, are counted over all documents while
signatures are made. Queries are taken in blocks of a fixed number of terms; a task searches a shard, of a fixed number of bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.bpe import slices
from galley.llm.common import stored
from galley.operators.joins import small_broadcast

#: A term is a run of ASCII letters and digits and of all that is not ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Numbers of occurrences from which a term is another fact, and bits and slices of a fact.
LEVELS, BITS, HASHES = (1, 2, 4), 12, 4
LEAST_BITS, SHARD_BYTES, SHARD_ROWS = 256, 4 << 20, 16_384
BLOCK_TERMS, HELD_TERMS, SLICE_CHARS = 100_000, 200_000, 1_000_000
INDEX = "name BIGINT, row INT, id BIGINT, n BIGINT, bits INT, signature BINARY, term STRING, df BIGINT"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


class FactHashes(dict):
    """Four 32-bit numbers of a ``(term, level)``, each asked for once."""

    def __missing__(self, fact: tuple[str, int]) -> bytes:
        value = self[fact] = xxhash.xxh128_digest(fact[0].encode("utf-8", "replace"), fact[1])
        return value


FACTS = FactHashes()


def places(facts: list[tuple[str, int]], bits: int) -> np.ndarray:
    """Places of each fact's bits in a signature of so many, a power of two."""
    if len(FACTS) > HELD_TERMS:
        FACTS.clear()
    raw = b"".join(map(FACTS.__getitem__, facts))
    return (np.frombuffer(raw, "<u4").reshape(-1, HASHES) & np.uint32(bits - 1)).astype(np.int64)


def facts_of(counts: Counter) -> list[tuple[str, int]]:
    return [(t, level) for level, least in enumerate(LEVELS) for t, c in counts.items() if c >= least]


def signature_bits(facts: int) -> int:
    return max(LEAST_BITS, 1 << (BITS * facts - 1).bit_length())


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of documents that have terms, and now and then the document frequencies met since."""
    names = ["name", "row", "id", "n", "bits", "signature", "term", "df"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64()]
    held: Counter = Counter()

    def frequencies():
        columns = [pa.nulls(len(held), t) for t in types[:6]]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(held.keys(), types[6]), pa.array(held.values(), types[7])], names)
        held.clear()
        return out

    for batch in batches:
        at = 0
        for texts in slices(pc.fill_null(batch.column(3), ""), SLICE_CHARS):
            rows = []
            for i, text in enumerate(texts, at):
                found = terms(text)
                if found:
                    counts = Counter(found)
                    held.update(counts.keys())
                    facts = facts_of(counts)
                    bits = signature_bits(len(facts))
                    one = np.zeros(bits, bool)
                    one[places(facts, bits)] = True
                    rows.append((i, len(found), bits, np.packbits(one, bitorder="little").tobytes()))
            at += len(texts)
            if rows:
                where, n, bits, signature = zip(*rows)
                own = [batch.column(c).take(pa.array(where)) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n, types[3]), pa.array(bits, types[4]), pa.array(signature, types[5]),
                     pa.nulls(len(where), types[6]), pa.nulls(len(where), types[7])], names)
            if len(held) > HELD_TERMS:
                yield frequencies()
    if held:
        yield frequencies()


class Index:
    """Signatures ``(name, row, id, n, bits, signature, shard)``, vocabulary ``(term, df)``, and the two totals."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        named = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t"))
        # rows that repeat a key and a text have one name and are scored each
        self.docs = named.select(F.xxhash64("id", "t").alias("name"), F.hash("t", "id").alias("row"), "id", "t")
        found = stored(self.docs.mapInArrow(_index, INDEX), "index")
        self.vocabulary = stored(found.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")), "vocabulary")
        rows = found.filter("term IS NULL").drop("term", "df")
        sizes = rows.groupBy("bits").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()  # a row per power of two
        self.documents, self.terms = sum(r["rows"] for r in sizes), sum(r["n"] for r in sizes)
        shards = F.lit(1)
        for r in sizes:
            most = max(64, min(SHARD_ROWS, 8 * SHARD_BYTES // r["bits"]))
            shards = F.when(F.col("bits") == r["bits"], -(-r["rows"] // most)).otherwise(shards)
        deal = F.pmod(F.xxhash64("name", "row"), shards).cast("int")
        self.signatures = stored(rows.withColumn("shard", deal).repartition("bits", "shard"), "signatures")


# scores ---------------------------------------------------------------------------------------------

def measure(n, documents: int, total: int):
    """The part of the length in a score: 75 and 25 times the length over the mean."""
    return 75 + (25 * n * documents) // total


def contribution(tf, m):
    """What a term counts, in billionths of its weight times a thousand."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Block:
    """Queries of one block: their distinct terms, and per query places, weights and repeats of its terms."""

    def __init__(self, queries: list[tuple[int, dict[str, int]]]):
        self.terms = sorted({t for _, weights in queries for t in weights})
        place = {t: i for i, t in enumerate(self.terms)}
        self.numbers = np.array([number for number, _ in queries], np.int64)
        self.parts = [(np.array([place[t] for t in weights], np.int64), np.array(list(weights.values()), np.int64)) for _, weights in queries]


def blocks(items: DataFrame, index: Index, key: str, text: str) -> Iterator[tuple[DataFrame, Block]]:
    """Blocks of queries with the weights of their terms, repeats counted in: a fixed number of terms at a time."""
    rows = items.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    @F.pandas_udf("array<string>")
    def cut(texts):
        return texts.map(terms)

    numbered = stored(rows.withColumn("number", F.monotonically_increasing_id()), "queries")
    found = numbered.select("number", "id", F.explode(cut("t")).alias("term")).groupBy("number", "id", "term").agg(F.count("*").alias("times"))
    ratio = F.lit(2.0 * index.documents + 2) / (2 * F.coalesce("df", F.lit(0)) + 1)
    weight = F.floor(1000 * F.log(ratio)).cast("bigint")
    weighed = stored(found.join(index.vocabulary, "term", "left").select("number", "id", "term", (weight * F.col("times")).alias("w")), "weighed")
    sizes = weighed.groupBy("number").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.orderBy("number")) - F.col("c")
    placed = stored(sizes.select("number", F.floor(before / BLOCK_TERMS).cast("int").alias("block")), "blocks")
    for b in range((placed.agg(F.max("block")).first()[0] + 1) if not placed.isEmpty() else 0):
        mine = placed.filter(F.col("block") == b)
        queries: dict[int, dict[str, int]] = {}
        for r in weighed.join(mine, "number").select("number", "term", "w").orderBy("number", "term").toLocalIterator():
            queries.setdefault(r["number"], {})[r["term"]] = r["w"]
        yield weighed.join(mine, "number").select("number", F.col("id").alias("item")).distinct(), Block(list(queries.items()))


def shard_bounds(block: Block, n: np.ndarray, signatures: np.ndarray, documents: int, total: int) -> Iterator[np.ndarray]:
    """For each query of the block an upper bound of the score of each of a shard's documents.

    ``signatures`` is a matrix of bytes, a row a document; its transpose holds the slices.
    """
    bits = 8 * signatures.shape[1]
    slots = np.unpackbits(signatures, axis=1, bitorder="little").T  # a row a slice, a byte a document
    slices_ = np.packbits(slots, axis=1)
    held = []
    for level in range(len(LEVELS)):
        at = places([(t, level) for t in block.terms], bits)
        both = slices_[at[:, 0]]
        for k in range(1, HASHES):
            both &= slices_[at[:, k]]
        if level:  # who has a term so often has it less often too
            both &= held[-1]
        held.append(both)
    m = measure(n, documents, total)
    most = [contribution(np.minimum(n, least - 1), m) for least in LEVELS[1:]] + [contribution(n, m)]
    steps = np.diff(np.stack([np.zeros_like(m), *most]), axis=0)
    for at, weights in block.parts:
        bound = np.zeros(len(n), np.int64)
        for level, step in enumerate(steps):
            seen = np.unpackbits(held[level][at], axis=1, count=len(n))
            bound += (weights.astype(np.float64) @ seen).astype(np.int64) * step  # sums below 2**53 are exact
        yield bound


def _bounds(block, documents: int, total: int, k: int, least: dict[int, int] | None):
    """A shard to ``(number, name, row, bound)``: each query's ``k`` highest bounds, or all from its threshold on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        parts = [b.to_pandas() for b in batches]
        if not parts:
            return
        shard = pd.concat(parts)
        signatures = np.frombuffer(b"".join(shard["signature"]), np.uint8).reshape(len(shard), -1)
        name, row, n = (shard[c].to_numpy() for c in ("name", "row", "n"))
        for number, bound in zip(block.value.numbers, shard_bounds(block.value, n, signatures, documents, total)):
            if least is None:
                keep = np.argpartition(-bound, k - 1)[:k] if len(bound) > k else np.arange(len(bound))
                keep = keep[bound[keep] > 0]
            else:
                keep = np.flatnonzero(bound >= max(1, least.get(int(number), 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keep), number)), pa.array(name[keep]), pa.array(row[keep]), pa.array(bound[keep])],
                ["number", "name", "row", "bound"])

    return run


def _by_shard(run):
    def one(key, table):
        found = list(run(iter(table.to_batches())))
        return pa.Table.from_batches(found, FOUND)

    return one


FOUND = pa.schema([("number", pa.int64()), ("name", pa.int64()), ("row", pa.int32()), ("bound", pa.int64())])


def _scores(block, documents: int, total: int):
    """Rows ``(numbers, id, t)`` to exact scores ``(number, id, score)`` above zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(number): i for i, number in enumerate(block.value.numbers)}
        where = {t: i for i, t in enumerate(block.value.terms)}
        for batch in batches:
            out = []
            for numbers, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = terms(text.as_py())
                m = measure(len(found), documents, total)
                counts = {where[t]: contribution(c, m) for t, c in Counter(found).items() if t in where}
                for number in numbers:
                    at, weights = block.value.parts[place[number]]
                    score = sum(w * counts[i] for i, w in zip(at.tolist(), weights.tolist()) if i in counts)
                    if score > 0:
                        out.append((number, key, score))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "id", "score"])

    return run


def _rescored(index: Index, candidates: DataFrame, block) -> DataFrame:
    """Exact scores of the candidates ``(number, name, row)``."""
    wanted = stored(candidates.groupBy("name", "row").agg(F.collect_set("number").alias("numbers")), "wanted")
    rows = index.docs.join(small_broadcast(wanted), ["name", "row"]).select("numbers", "id", "t")
    return stored(rows.mapInArrow(_scores(block, index.documents, index.terms), "number BIGINT, id BIGINT, score BIGINT"), "scores")


def _top(scores: DataFrame, k: int, order: list) -> DataFrame:
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 20, item_key: str = "item_id", item_text: str = "text",
           key: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """``(item_key, rank, key, score)``: each item's ``k`` documents of highest score above zero, equal ones by ascending key.

    An item row is a query of its own, also if its key repeats; those without terms, or whose terms no document has, give no row.
    Null texts have no terms. Rows that repeat a key and a text are documents of their own; a null key comes first.
    Scores are 64-bit whole numbers. Other columns are not looked at.
    """
    index = index or Index(docs, key, text)
    spark, out = docs.sparkSession, None
    for ids, queries in blocks(items, index, item_key, item_text):
        block = spark.sparkContext.broadcast(queries)
        by_shard = index.signatures.groupBy("bits", "shard")

        def bounds(least):
            return by_shard.applyInArrow(_by_shard(_bounds(block, index.documents, index.terms, k, least)),
                                         "number BIGINT, name BIGINT, row INT, bound BIGINT")

        first = stored(_top(bounds(None), k, [F.desc("bound"), "name", "row"]).select("number", "name", "row"), "first")
        scores = _rescored(index, first, block)
        best = _top(scores, k, [F.desc("score"), F.col("id").asc_nulls_first()]).filter(F.col("rank") == k).select("number", "score")
        least = {r["number"]: r["score"] for r in best.collect()}  # at most a number per query of the block
        rest = stored(bounds(least).select("number", "name", "row"), "competitive")
        rest = rest.join(first, ["number", "name", "row"], "left_anti")
        scores = scores.unionByName(_rescored(index, rest, block))
        top = _top(scores, k, [F.desc("score"), F.col("id").asc_nulls_first()]).join(ids, "number")
        top = top.select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
        out = out.unionByName(stored(top, "top")) if out is not None else stored(top, "top")
    return out if out is not None else spark.createDataFrame([], f"{item_key} BIGINT, rank INT, {key} BIGINT, score BIGINT")
