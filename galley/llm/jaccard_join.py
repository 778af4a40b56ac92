"""Similarity join on sets of word shingles by several global token orders.

Texts with equal sets are one node. Under any order of all shingles, two sets whose Jaccard similarity is at least
``t`` share a shingle among the first ``n - ceil(t * n) + 1`` of each. That holds for every order, so a candidate pair
must meet in the prefixes of all ``ORDERS`` orders; the filters are intersected before a pair is verified on the whole
sets. The orders decide how many strangers meet, never the result.

The first order puts shingles ahead that one node alone holds, as counted in a part of the hash space: a node whose
prefix is full of them meets nobody and is out, before any pair is made. Those that stay are counted again among
themselves, over all shingles; of nodes that still stay the orders sort the shared shingles by how many nodes hold
them, exactly or by powers of two, and deal equal ones differently, behind the shingles of one node.

Pairs come in two rounds. Stars: every shared shingle has one centre, each node is verified against the centre it
shares most prefix shingles with, at most one pair a node, and links are joined to components. Then all members of a
shared shingle's bucket that lie in different components are paired, first each with its nearest: buckets are cut into
chunks and pairs of chunks into cells, which test sizes, places and how far parity bits of the whole sets are apart.
So a large group of copies is not expanded, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.llm.bpe import slices
from galley.llm.common import stored
from galley.llm.simhash import connected
from galley.operators.joins import small_broadcast

SIZE, PERCENT, ORDERS = 4, 85, 3
#: 64-bit words of a set's parity bits, and the names of those they fold to for cells.
PARITIES, FOLDED = 16, ("w0", "w1", "w2", "w3")
CHUNK, TABLE, SLICE_CHARS = 2048, 1 << 18, 1_000_000
#: A worker remembers so many words of at most so many bytes.
CACHED_WORDS, CACHED_BYTES = 100_000, 32
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# sets -----------------------------------------------------------------------------------------------

class WordHashes(dict):
    """XXH64 of words; those remembered are few and short, whatever the texts."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


WORDS = WordHashes()


def forget_words() -> None:
    """A task's code comes pickled with copies of what it names; this clears the worker's own."""
    WORDS.clear()


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers, another for each seed."""
    values = values ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    values = (values ^ (values >> np.uint64(32))) * MIX
    return values ^ (values >> np.uint64(29))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words, if they are fewer; none without words.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(words) - size + 1)
    total = np.full(runs, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        total = total * STEP + each[k:k + runs]
    return np.unique(mixed(total))


def prefix_size(n: Column, percent: int) -> Column:
    """Shingles of a set of ``n`` of which any set that links with it shares one, whatever the order; as a number of 32 bits."""
    return (n - F.ceil((percent * n) / 100) + 1).cast("int")


def parities(values: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's shingles falls on each of ``64 * PARITIES`` bits.

    Every shingle that only one of two sets has flips one bit, so they differ in no more bits than in shingles.
    """
    counts = np.bincount((values >> np.uint64(20)) % np.uint64(64 * PARITIES), minlength=64 * PARITIES)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def node_of(values: np.ndarray) -> int | None:
    """A set's name; an empty set has none."""
    return xxhash.xxh64_intdigest(values.tobytes()) - (1 << 63) if len(values) else None


def arrays(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(parts).view(np.int64))).cast(pa.list_(pa.int64()))


def counted_eighths(percent: int) -> int:
    """Eighths of the hash space that the first count takes: some 1.75 times a prefix's share of the shingles."""
    return max(1, min(8, round(0.14 * (100 - percent))))


def add_sets(rows: DataFrame, text: str, size: int, eighths: int = 8, parity: bool = False, **others: Callable[[str], int]) -> DataFrame:
    """Replace the text column by the set's ``node`` and ``n`` and, as ``set``, its shingles in so much of the hash space.

    With ``parity`` the whole set's parities come along as ``bits``, so that sets need not cross to Python again. ``others`` are
    more columns, numbers made from a text. Texts are taken in small slices, so that a worker holds few sets at a time, and
    the words it remembers go with its task.
    """
    kept = [c for c in rows.columns if c != text]
    folds = ["bits"] if parity else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(pc.fill_null(batch.column(text), ""), SLICE_CHARS):
                sets = [shingle_set(t, size) for t in texts]
                some = sets if eighths == 8 else [s[(s & np.uint64(7)) < eighths] for s in sets]
                columns = [batch.column(c).slice(at, len(texts)) for c in kept]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), arrays(some),
                     *[arrays([parities(s) for s in sets]) for _ in folds],
                     *[pa.array([made(t) for t in texts], pa.int64()) for made in others.values()]],
                    [*kept, "node", "n", "set", *folds, *others])
        forget_words()

    made = T.StructType().add("node", T.LongType()).add("n", T.IntegerType()).add("set", T.ArrayType(T.LongType()))
    for name in folds:
        made = made.add(name, T.ArrayType(T.LongType()))
    for name in others:
        made = made.add(name, T.LongType())
    return rows.mapInArrow(run, T.StructType([*rows.select(*kept).schema.fields, *made.fields]))


# buckets --------------------------------------------------------------------------------------------

def can_link(n: Column, m: Column, after: Column, other_after: Column, percent: int) -> Column:
    """Whether sets of sizes ``n`` and ``m`` can link if they share nothing before places that leave so many shingles."""
    return (100 + percent) * F.least(after, other_after) >= percent * (n + m)


def alone(keyed: DataFrame) -> DataFrame:
    """``(node, alone)``: how many shingles ``h`` of the rows ``(node, h)`` no other node has. Repeated rows count once."""
    held = keyed.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
    return held.groupBy("node").agg(F.count("*").alias("alone"))


def crowded(nodes: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """The ``nodes`` (with size ``n``) whose shingles of their own do not fill the prefix."""
    met = nodes.join(alone(keyed), "node", "left")
    return met.filter(F.coalesce("alone", F.lit(0)) < prefix_size(F.col("n"), percent)).drop("alone")


def met_in(sets: DataFrame, orders: int, percent: int) -> DataFrame:
    """Rows ``(order, h, node, n, place)``: the shared shingles in the prefixes of ``(node, n, set)`` under each order."""
    keyed = sets.select("node", "n", F.explode("set").alias("h"))
    held = stored(keyed.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "held")
    shared = keyed.join(held, "h").groupBy("node", "n").agg(F.collect_list(F.struct("df", "h")).alias("shared"))
    own = F.col("n") - F.size("shared")
    left = prefix_size(F.col("n"), percent) - own
    shared = shared.select("node", "n", own.alias("own"), left.alias("left"), "shared").filter("left > 0")

    def ranked(order: int) -> Column:
        rank = (lambda df: df.cast("double")) if not order else lambda df: F.floor(F.log2(df) / order).cast("double")
        by = F.transform("shared", lambda e: F.struct(rank(e["df"]).alias("rank"), F.xxhash64(e["h"], F.lit(order)).alias("deal"),
                                                      e["h"].alias("h")))
        return F.slice(F.sort_array(by), F.lit(1), F.col("left"))

    each = [shared.select(F.lit(o).alias("order"), "node", "n", "own", F.posexplode(ranked(o)).alias("place", "e")) for o in range(orders)]
    rows = each[0]
    for other in each[1:]:
        rows = rows.unionByName(other)
    return rows.select("order", F.col("e.h").alias("h"), "node", "n", (F.col("place") + F.col("own")).alias("place"))


def stars(met: DataFrame, orders: int, percent: int) -> DataFrame:
    """One pair ``(a, b)`` a node at most: with the bucket centre that it shares most prefix shingles with, under all orders."""
    centre = F.min(F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("b"), F.col("n").alias("m")))
    centres = met.groupBy("order", "h").agg(centre.alias("c"))
    fits = F.least("n", "c.m") * 100 >= percent * F.greatest("n", "c.m")
    pairs = met.join(centres, ["order", "h"]).filter((F.col("node") != F.col("c.b")) & fits)
    pairs = pairs.select(F.col("node").alias("a"), F.col("c.b").alias("b"), "order")
    pairs = pairs.groupBy("a", "b").agg(seen_under(), F.count("*").alias("shared")).filter(F.col("seen") == (1 << orders) - 1)
    best = pairs.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def seen_under() -> Column:
    return F.bit_or(F.expr("shiftleft(1, `order`)")).alias("seen")


def _pair_cells(percent: int, nearest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells to the pairs of members of two components that can link, or for each member to the nearest of them."""

    def run(batches):
        for batch in batches:
            for order, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                cell = [np.array(members.values.field(f)) for f in ("node", "root", "n", "place", *FOLDED)]
                first = np.unique(cell[0], return_index=True)[1]
                node, root, n, place, *words = (x[first] for x in cell)
                n, after = n.astype(np.int64), (n - place).astype(np.int64)
                rows = max(1, TABLE // len(node))
                for a in range(0, len(node), rows):
                    part = slice(a, a + rows)
                    either = n[part, None] + n[None, :]
                    fits = (100 + percent) * np.minimum(after[part, None], after[None, :]) >= percent * either
                    far = sum(np.bitwise_count(w[part, None] ^ w[None, :]).astype(np.int64) for w in (w.view(np.uint64) for w in words))
                    fits &= (root[part, None] != root[None, :]) & ((100 + percent) * far <= (100 - percent) * either)
                    if nearest:
                        y = np.where(fits, far, 64 * len(words) + 1).argmin(axis=1)
                        x = np.flatnonzero(fits[np.arange(len(y)), y])
                        y = y[x]
                    else:
                        x, y = np.nonzero(fits & (node[part, None] < node[None, :]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), order, np.int32)), pa.array(node[part][x]), pa.array(node[y]), pa.array(far[x, y])],
                        ["order", "a", "b", "far"])

    return run


def pairs_between(met: DataFrame, roots: DataFrame, bits: DataFrame, orders: int, percent: int, chunk: int = CHUNK,
                  nearest: bool = False) -> DataFrame:
    """All pairs ``(a, b)`` of nodes of different components that can link under each of the orders.

    With ``nearest`` only one pair a node, that of the fewest differing parity bits.
    """
    folded = [sum_of_bits(i).alias(name) for i, name in enumerate(FOLDED)]
    rest = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_up = rest.groupBy("order", "h").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"))
    mixed_up = mixed_up.filter("least != most").select("order", "h", F.ceil(F.col("size") / chunk).cast("int").alias("chunks"))
    rest = rest.join(stored(mixed_up, "mixed"), ["order", "h"]).join(small_broadcast(bits.select("node", *folded)), "node")
    own = F.pmod(F.xxhash64("node", "h"), F.col("chunks")).cast("int")
    cells = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = cells.groupBy("order", "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("node", "root", "n", "place", *FOLDED)).alias("members"))
    found = members.select("order", "members").mapInArrow(_pair_cells(percent, nearest), "order INT, a BIGINT, b BIGINT, far BIGINT")
    pairs = found.groupBy("a", "b").agg(seen_under(), F.min("far").alias("far")).filter(F.col("seen") == (1 << orders) - 1)
    if nearest:
        pairs = pairs.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return pairs.select("a", "b")


def sum_of_bits(i: int) -> Column:
    """One of the words that parity bits fold to: the parity of fewer, wider classes."""
    word = F.col("bits")[i]
    for k in range(i + len(FOLDED), PARITIES, len(FOLDED)):
        word = word.bitwiseXOR(F.col("bits")[k])
    return word


def not_far(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity bits ``(node, n, bits)`` differ in no more places than sets that link can."""
    for end in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("node").alias(end), F.struct("n", "bits").alias(f"of_{end}")), end)
    words = [F.bit_count(F.col("of_a.bits")[i].bitwiseXOR(F.col("of_b.bits")[i])) for i in range(PARITIES)]
    return pairs.filter((100 + percent) * sum(words) <= (100 - percent) * (F.col("of_a.n") + F.col("of_b.n"))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets ``(node, set)`` have the similarity; ``bits`` spare most of the others."""
    pairs = stored(not_far(pairs, bits, percent), "pairs")
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x")).join(small_broadcast(pairs), "a")
    asked = pairs.select(F.col("b").alias("node")).distinct()
    right = sets.join(small_broadcast(asked), "node", "left_semi").select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = left.join(right, "b").filter((100 + percent) * both >= percent * (F.size("x") + F.size("y")))
    return stored(near.select("a", "b"), "links")


# the join -------------------------------------------------------------------------------------------

def linked_nodes(docs: DataFrame, key: str, text: str, size: int = SIZE, percent: int = PERCENT, orders: int = ORDERS,
                 chunk: int = CHUNK, proposed: Callable[[DataFrame], DataFrame] | None = None,
                 **others: Callable[[str], int]) -> tuple[DataFrame, DataFrame]:
    """``(key, ROW1, ROW2, node, n)`` of every row and ``(node, root)`` of the nodes that link with another.

    ``root`` is the smallest node of a component. Names are 64-bit digests of whole sets; ``ROW1`` and ``ROW2`` name a row by
    hashes of its key and text, while texts stay behind. ``proposed`` makes more pairs ``(a, b)`` for the first round
    from the first table, which has the columns ``others`` made from a text too.
    """
    named = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    named = named.withColumns({"ROW1": F.xxhash64("key", "t"), "ROW2": F.hash("t", "key")})
    found = stored(add_sets(named, "t", size, counted_eighths(percent), **others), "found")
    nodes = found.filter("n > 0").groupBy("node").agg(F.min(F.struct("ROW1", "ROW2")).alias("row"), F.first("n").alias("n"))
    keyed = found.filter("n > 0").select("node", F.explode("set").alias("h"))
    wanted = stored(crowded(nodes, keyed, percent).select("node", "row.ROW1", "row.ROW2"), "wanted")
    # rows that repeat a key and a text have one name
    texts = named.join(small_broadcast(wanted), ["ROW1", "ROW2"]).groupBy("node").agg(F.first("t").alias("t"))
    sets = stored(add_sets(texts.select("t"), "t", size, parity=True), "sets")
    close = stored(crowded(sets.select("node", "n"), sets.select("node", F.explode("set").alias("h")), percent).select("node"), "close")
    sets = stored(sets.join(small_broadcast(close), "node", "left_semi"), "sets")
    bits = stored(sets.select("node", "n", "bits"), "bits")
    sets = sets.select("node", "n", "set")

    met = stored(met_in(sets, orders, percent), "met")
    alive = met.groupBy("node").agg(seen_under()).filter(F.col("seen") == (1 << orders) - 1)
    met = stored(met.join(small_broadcast(stored(alive.select("node"), "alive")), "node", "left_semi"), "met")
    pairs = stars(met, orders, percent)
    if proposed:
        here, more = small_broadcast(close), proposed(found.drop("set"))
        for end in ("a", "b"):
            more = more.join(here.withColumnRenamed("node", end), end, "left_semi")
        pairs = pairs.unionByName(more.select("a", "b")).distinct()
    links = verified(pairs, sets, bits, percent)
    for nearest in (True, True, False):
        roots = stored(connected(links, "a", "b"), "roots")
        more = verified(pairs_between(met, roots, bits, orders, percent, chunk, nearest), sets, bits, percent)
        links = links.unionByName(more)
    if not more.isEmpty():
        roots = stored(connected(links, "a", "b"), "roots")
    return found.drop("set"), roots


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT,
               orders: int = ORDERS, chunk: int = CHUNK) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row: the smallest key within reach over links of the similarity.

    Two sets link when ``100 * both >= percent * either``. Null texts and texts without words have an empty set and link with
    nothing, so that their component is their own key. Rows with equal keys stay separate rows; a null key stands for a
    component only if that has no other. Other columns are not looked at.
    """
    found, roots = linked_nodes(docs, key, text, size, percent, orders, chunk)
    rows = found.join(roots, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root"))
    rows = stored(rows, "rows")
    least = rows.filter("n > 0").groupBy("root").agg(F.min("key").alias("least"))
    met = rows.join(stored(least, "least"), "root", "left")
    return met.select(F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))
