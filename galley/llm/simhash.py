"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has a bit set where more than half of its features' 64-bit hashes have it. Copies
meet first: all further work is on distinct fingerprints. Fingerprints are split into ``blocks`` runs of
bits; two that differ in at most ``radius`` bits agree on at least ``blocks - radius`` whole runs, so every
choice of that many runs is a key, and each close pair shares the key of some choice. With six blocks and
radius 4 that is 15 keys of about 21 bits: few strangers meet.

Within a key's bucket no pairs are emitted. A bucket is cut into chunks of at most ``chunk`` fingerprints and
every pair of chunks is a cell; the cell links its members by verified Hamming distance and emits one
edge per member, to the smallest member of its component there. So a bucket of any size, such as that of
a large group of near copies, spreads over many tasks. Components are then joined by alternating large and
small stars over the shared folder, the smallest fingerprint of a component standing for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.common import stored

SEED = 42
CHUNK, ROWS = 2048, 256
WORD = (1 << 64) - 1


# fingerprints ---------------------------------------------------------------------------------------

def shingles(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; a shorter text is one run, an empty one none.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    """
    words = text.encode().lower().split()
    if not words:
        return []
    if size == 1:
        return words
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.r_[0, ends[:-1] + 1]
    last = ends[size - 1:] if len(words) > size else ends[-1:]
    return [joined[a:b] for a, b in zip(begins[:len(last)].tolist(), last.tolist())]


def word_set(text: str) -> list[bytes]:
    """Distinct words, A-Z lower-cased, without the ASCII punctuation around them."""
    return [*{w.strip(b".,;:!?\"'()[]|*&%$#") for w in text.encode().lower().split()} - {b""}]


def fingerprint(features: list[bytes]) -> int:
    """Bits set in over half of the features' XXH64 hashes, as a signed 64-bit number."""
    if not features:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(f, SEED) for f in features], "<u8")
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[part:part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4, out: str = "fp",
                 features: Callable[[str], list[bytes]] | None = None) -> DataFrame:
    """Add the fingerprint of a text column; null and empty texts have the fingerprint zero."""

    @F.pandas_udf("bigint")
    def hashed(texts):
        import pandas as pd

        return pd.Series([fingerprint(features(t) if features else shingles(t, size)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(out, hashed(F.col(text).cast("string")))


# candidate buckets ----------------------------------------------------------------------------------

def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of the blocks, as signed numbers."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be smaller than the number of blocks")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(runs, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _components(values: np.ndarray, radius: int) -> np.ndarray:
    """Place of the first member of each value's component; values are sorted, links are Hamming distances.

    Rows are taken ``ROWS`` at a time, so that only a byte per pair of a cell is held.
    """
    size = len(values)
    close = np.empty((size, size), bool)
    for a in range(0, size, ROWS):
        close[a:a + ROWS] = np.bitwise_count(values[a:a + ROWS, None] ^ values[None, :]) <= radius
    label = close.argmax(axis=1)  # the first that is close to it, itself at the latest
    while True:
        best = np.empty(size, np.int64)
        for a in range(0, size, ROWS):
            best[a:a + ROWS] = np.where(close[a:a + ROWS], label, size).min(axis=1)
        best = np.minimum(best, best[best])
        if (best == label).all():
            return label
        label = best


def _link_cells(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells, each the sorted distinct fingerprints of its one or two chunks, to edges ``(fp, least)``."""

    def run(batches):
        for batch in batches:
            left, right, pairs = [], [], []
            for members in batch.column(0).to_pylist():
                if len(members) == 2:  # nearly all cells
                    a, b = sorted(members)
                    if a != b and ((a ^ b) & WORD).bit_count() <= radius:
                        pairs.append((b, a))
                    continue
                values = np.unique(np.array(members, np.int64))
                label = _components(values.view(np.uint64), radius)
                moved = np.flatnonzero(label != np.arange(len(values)))
                left.append(values[moved])
                right.append(values[label[moved]])
            found = np.array(pairs, np.int64).reshape(-1, 2)
            left.append(found[:, 0])
            right.append(found[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["fp", "least"])

    return run


def near_edges(distinct: DataFrame, radius: int = 4, blocks: int = 6, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(fp, least)`` that connect all distinct fingerprints within ``radius`` bits of one another.

    ``distinct`` has one ``fp`` column without repeats. Every link is inside a component of the edges;
    the edges number at most one per fingerprint and cell.
    """
    masks = block_masks(blocks, radius)
    choices = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                  for i, m in enumerate(masks)]))
    keyed = distinct.select("fp", choices.alias("k")).select("fp", "k.choice", "k.key")
    # buckets fold before the shuffle: a key's size is known before any of its members is moved
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = stored(sizes.select("choice", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "buckets")
    met = keyed.join(sizes, ["choice", "key"])
    own = F.pmod(F.xxhash64("fp", "choice"), F.col("chunks")).cast("int")
    cells = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = cells.groupBy("choice", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(
        F.collect_list("fp").alias("members"))
    linked = members.select("members").filter(F.size("members") > 1)
    return linked.mapInArrow(_link_cells(radius), "fp BIGINT, least BIGINT").distinct()


# components -----------------------------------------------------------------------------------------

def connected(edges: DataFrame, a: str = "fp", b: str = "least") -> DataFrame:
    """``(node, root)``: the smallest node each node of the edges reaches.

    Alternating stars: each node hooks its larger neighbours to its least neighbour, then its smaller ones.
    Every round is written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    stars = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        new = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            break
        state = new
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        stars = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4,
                    blocks: int = 6, chunk: int = CHUNK, features: Callable[[str], list[bytes]] | None = None) -> DataFrame:
    """``(key, fp, component_id)`` of every row: the smallest key within reach over links of at most ``radius`` bits.

    Rows with equal keys stay separate rows. A null key keeps its row and stands for a component only if
    that has no other. Null and empty texts have the fingerprint zero and link like any other.
    """
    prints = stored(fingerprints(docs.select(key, text), text, size, "fp", features).select(key, "fp"), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    roots = connected(near_edges(distinct.select("fp"), radius, blocks, chunk))
    reps = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    reps = stored(reps, "reps")
    least = reps.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = stored(reps.select("fp", "root").join(stored(least, "components"), "root").select("fp", "component_id"), "by_print")
    return prints.join(by_print, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **near) -> DataFrame:
    """The rows of ``docs`` without near copies: of every component the row of least key stays, a null key last.

    Of rows that share a component's least key the one of least text hash stays, and of rows with equal keys and
    texts one. ``near`` goes to the fingerprints (``size``, ``features``) and the links (``radius``, ``blocks``,
    ``chunk``). Rows are named by 96 bits of hashes of key and text while texts stay behind.
    """
    links = {k: near[k] for k in ("radius", "blocks", "chunk") if k in near}
    shape = {k: near[k] for k in ("size", "features") if k in near}
    named = docs.withColumns({"ROW1": F.xxhash64(key, text), "ROW2": F.hash(text, key)})
    prints = fingerprints(named.select(key, text, "ROW1", "ROW2"), text, out="fp", **shape)
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "ROW1", "ROW2")
    distinct = stored(prints.groupBy("fp").agg(F.min(rank).alias("first")), "distinct")
    roots = connected(near_edges(distinct.select("fp"), **links))
    reps = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = reps.groupBy("root").agg(F.min("first").alias("first"))
    kept = stored(kept.select(F.col("first.ROW1").alias("ROW1"), F.col("first.ROW2").alias("ROW2")), "kept")
    met = named.join(kept, ["ROW1", "ROW2"], "left_semi").dropDuplicates(["ROW1", "ROW2"])
    return met.select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
