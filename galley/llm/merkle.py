"""Merkle manifest of a table: a tree of digests per group, and one over the groups.

A row's leaf is the SHA-256 of its named columns, each as its length in bytes, ``:`` and its value, or ``-`` for null.
Within a group leaves ascend by key; every sixteen consecutive nodes have a parent, the digest of their digests, until
one node, the group's subroot, is left. Subroots, in the order of their groups, are the leaves of the tree above.

Each level is one window over chunks of 256 nodes: lag and lead columns at the fixed offsets 1 to 15, masked by the
node's slot and the length of its run, are its siblings, and the row of each first child hashes the parent. No window
holds more than a chunk, whatever the size of a group: places come from a sort by ranges, counted per range.
A row's proof is the list of its siblings by level, handed down from parent to child; folding a leaf through it gives
the root again if the row is unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.common import stored

RUN = 16
CHUNK = RUN * RUN
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value told apart from its neighbours: length in UTF-8 bytes, ``:``, the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_name(group: Column) -> Column:
    """A group as a string that is never null and sorts alike: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, a row's place in its group ``g`` by the order, from 0, and ``n``, the group's size.

    Rows are dealt by ranges of group and order, so a group of any size is spread; only counts per range are summed up.
    """
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stored(dealt.withColumns({"part": F.spark_partition_id(), "place": place}), "dealt")
    parts = dealt.groupBy("g", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    by_group = W.partitionBy("g")
    before = F.sum("rows").over(by_group.orderBy("part")) - F.col("rows")
    parts = parts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(by_group).alias("n"))
    met = dealt.join(parts, ["g", "part"]).withColumn("pos", F.col("place") + F.col("shift"))
    return met.drop("part", "place", "shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add ``left`` and ``right``, the digests of a node's siblings before and behind it, and ``chunk``."""
    nodes = nodes.withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    within = W.partitionBy("g", "chunk").orderBy("pos")
    slot = F.col("pos") % RUN
    length = F.least(F.lit(RUN), F.col("n") - F.col("pos") + slot)
    lags = [F.when(slot >= d, F.lag("h", d).over(within)).otherwise("") for d in range(RUN - 1, 0, -1)]
    leads = [F.when(slot + d < length, F.lead("h", d).over(within)).otherwise("") for d in range(1, RUN)]
    return nodes.withColumns({"left": F.concat(*lags), "right": F.concat(*leads)})


def parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes with siblings: first children hash it."""
    first = nodes.filter((F.col("n") > 1) & (F.col("pos") % RUN == 0))
    return first.select("g", F.expr(f"pos div {RUN}").alias("pos"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"),
                        F.sha2(F.concat("h", "right"), 256).alias("h"))


def level_count(size: int | None) -> int:
    """Levels of the tree over ``size`` leaves, the root's included."""
    levels = 1 if size else 0
    while size and size > 1:
        size, levels = -(-size // RUN), levels + 1
    return levels


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes with siblings of the given level and all above; groups end where ``n`` is 1."""
    found = []
    for _ in range(levels):
        found.append(stored(with_siblings(nodes), "level"))
        nodes = parents(found[-1])
    return found


def descend(levels: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """Proofs ``path`` of the lowest of the levels; ``tops`` has the path and other columns of each group's root."""
    below = None
    for level in reversed(levels):
        here = level.filter("n = 1").join(tops, "g").select("g", "pos", "path", *carried)
        if below is not None:
            above = below.withColumnsRenamed({"pos": "up", "path": "above"})
            met = level.filter("n > 1").withColumn("up", F.expr(f"pos div {RUN}")).join(above, ["g", "up"])
            step = F.array(F.struct("left", "right"))
            here = here.unionByName(met.select("g", "pos", F.concat(step, "above").alias("path"), *carried))
        below = stored(here, "paths")
    return below


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings by level give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, changed: Column, key: str = "doc_id", group: str = "source",
             columns: tuple[str, ...] = COLUMNS, **changes: Column) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row, checked against changed rows.

    Where the condition ``changed`` holds, the leaf is recomputed with the columns of ``changes`` in place of the
    given ones, and folded with the siblings of the unchanged tree; elsewhere the leaf itself is. Keys ascend, a null
    first; rows with equal keys go by their leaves, and whole copies of a row are leaves of their own. A null group comes
    first. An empty table gives an empty manifest; a null condition counts as false. Other columns are not looked at.
    """
    original = leaf_digest(*[F.col(c) for c in columns])
    other = leaf_digest(*[changes.get(c, F.col(c)) for c in columns])
    leaves = docs.select(group_name(F.col(group)).alias("g"), F.col(key).alias("key"), original.alias("h"),
                         F.when(changed, other).alias("other"))
    leaves = stored(leaves, "leaves").withColumn("tie", F.monotonically_increasing_id())
    leaves = stored(numbered(leaves, ["key", "h", "tie"]).drop("tie"), "numbered")
    levels = climb(stored(parents(with_siblings(leaves.drop("key", "other"))), "parents"),
                   level_count(leaves.agg(F.max("n")).first()[0]) - 1)

    alone = leaves.filter("n = 1").select("g", "h")
    ends = [level.filter("n = 1").select("g", "h") for level in levels]
    subroots = alone
    for end in ends:
        subroots = subroots.unionByName(end)
    subroots = stored(subroots.select(F.lit(0).alias("g"), F.col("g").alias("name"), "h"), "subroots")
    tops = stored(numbered(subroots, ["name"]), "tops")
    above = climb(tops.drop("name"), max(1, level_count(tops.agg(F.max("n")).first()[0])))
    root = above[-1].first()
    empty = F.array().cast("array<struct<left:string,right:string>>")
    paths = descend(above, above[-1].filter("n = 1").select("g", empty.alias("path")))
    tops = tops.join(paths, ["g", "pos"]).select(F.col("name").alias("g"), F.col("h").alias("subroot"), "path")
    tops = stored(tops, "tops")

    # the leaves of a chunk have at most RUN parents: their paths travel together
    lone = alone.join(tops, "g").select("g", F.lit(0).cast("bigint").alias("pos"), "path", "subroot")
    paths = descend(levels, tops, "subroot").unionByName(lone) if levels else lone
    packs = paths.groupBy("g", F.expr(f"pos div {RUN}").alias("chunk")).agg(
        F.first("subroot").alias("subroot"), F.sort_array(F.collect_list(F.struct("pos", "path"))).alias("paths"))
    met = with_siblings(leaves).join(packs, ["g", "chunk"])
    above_leaf = F.col("paths")[(F.expr(f"pos div {RUN}") % RUN).cast("int")]["path"]
    step = F.array(F.struct("left", "right"))
    path = F.when(F.col("n") > 1, F.concat(step, above_leaf)).otherwise(above_leaf)
    met = met.select(F.col("key").alias(key), F.col("h").alias("leaf"), "subroot", F.lit(root and root["h"]).alias("root"),
                     F.coalesce("other", "h").alias("given"), path.alias("path"))
    return met.withColumn("folded_root", fold(F.col("given"), F.col("path"))).select(
        key, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
