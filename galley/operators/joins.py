"""Joins that hold up under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows up to which a lookup of short rows may be broadcast; checked, never assumed.
BROADCAST_ROWS = 200_000
# Rows of the heaviest keys that are broadcast when the whole lookup is too large.
HOT_ROWS = 10_000


#: Bytes of text that one partition takes where texts are dealt out to be taken apart.
PART_BYTES = 16 << 20


def text_bytes(df: DataFrame, *without: str) -> int:
    """Bytes of all strings, and strings of arrays, in a table; one pass."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name not in without}
    sizes = [F.octet_length(c) for c, kind in kinds.items() if kind == "string"]
    sizes += [F.octet_length(F.array_join(c, "")) for c, kind in kinds.items() if kind == "array<string>"]
    if not sizes:
        return 0
    return df.agg(sum((F.coalesce(F.sum(size), F.lit(0)) for size in sizes), F.lit(0))).first()[0]


def spread(df: DataFrame, key: str, size: int = 0) -> DataFrame:
    """Hash by key into the session's number of shuffle partitions, for rows about to be taken apart.

    The number is given outright: rows grow some twenty-fold after this shuffle, and a merge of small
    partitions by their size before it would leave few, huge tasks. With the table's ``size`` in bytes there are
    more of them where one would get more than ``PART_BYTES``, so that a task's share does not grow with the table.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    return df.repartition(parts, F.col(key))


def widen(df: DataFrame, bound: int = 1 << 30) -> DataFrame:
    """Deal a table below ``bound`` bytes out to all cores; a larger one comes in enough parts.

    A small table sits in few files, and costly work on its rows would get as few tasks.
    """
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism) if size < bound else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most that many rows; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def small_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a table whose size was checked; else leave the choice to the engine."""
    return F.broadcast(df) if is_small(df, rows) else df


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of facts to a lookup with unique keys, whatever share of the facts one key holds.

    ``weight`` is the number of fact rows per key. A small lookup is broadcast whole. Else the
    heaviest ``hot_rows`` keys are broadcast, so their facts never shuffle, and every key left for
    the shuffle holds at most one part in ``hot_rows`` of the facts. No row is lost on either way.
    """
    if is_small(lookup, broadcast_rows):
        return facts.join(F.broadcast(lookup), key)
    hot = lookup.orderBy(F.desc(weight), key).limit(hot_rows)
    warm = facts.join(F.broadcast(hot), key)
    cold = facts.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup, key)
    return warm.unionByName(cold)
