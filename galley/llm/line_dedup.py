"""Repeated passages by hashing lines, paragraphs or pieces of them.

Texts are cut into units, a unit is normalised (lower case, white space runs as one blank) and hashed to 64 bits, and
digests are grouped over the whole corpus. The occurrence of least rank, key and then place, stays; the others are
repeats, with their places in the original text kept. A single repeated unit says little, be it a menu line or a few
common words: repeats that follow one another in a text are joined to runs, and a run is removed from ``RUN_WORDS`` words on.

Passages begin and end inside lines. The unit ``piece`` cuts lines again behind words chosen by their own hash, so that
a passage is cut alike wherever it stands; only its first and last words can fall into pieces that are not repeated. Those
are found exactly: at both ends of a run the words next to it are compared with the words next to the kept
occurrence, and the run takes in those that agree. Common digests fold before they are shuffled, so a line that a third
of all documents hold is one row per task; texts meet the ends of runs in one join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.llm.common import stored

UNITS = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"[^\n](?:[^\n]|\n(?!\s*\n))*"),
    "sentence": re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|\Z)"),
    "piece": re.compile(r"[^\n]+"),
}
FOUND = "KEY BIGINT, no INT, start INT, end INT, words INT, digest BIGINT"
#: Words of a run that is removed; words that its units hold before its ends are looked at.
RUN_WORDS, CORE_WORDS = 25, 12
#: A piece ends behind one word in so many, or after so many words; characters compared at an end of a run.
PIECE, PIECE_MOST, REACH = 6, 32, 240
WORD = re.compile(r"\S+")


class Ends(dict):
    """Whether a piece ends behind a word, by the word alone."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) % PIECE == 0
        return value


ENDS = Ends()


def cut(text: str, unit: str = "piece") -> Iterator[tuple[int, int, int, int]]:
    """``(start, end, words, digest)`` of each unit that has a word; blanks around a unit are not its own."""
    for match in UNITS[unit].finditer(text):
        words, low = match[0].split(), match[0].lower().split()
        at, first = match.start(), 0
        for i in _ends(low) if unit == "piece" else [len(low)] if low else []:
            part = " ".join(words[first:i])
            start = text.index(words[first], at)
            if text.startswith(part, start):
                at = start + len(part)
            else:  # blanks of other kinds or more of them
                at = start
                for word in words[first:i]:
                    at = text.index(word, at) + len(word)
            yield start, at, i - first, xxhash.xxh64_intdigest(" ".join(low[first:i]).encode("utf-8", "replace")) - (1 << 63)
            first = i


def _ends(words: list[str]) -> list[int]:
    """How many words lie before the end of each piece of a line."""
    out, last = [], 0
    for i in [i for i, word in enumerate(words, 1) if ENDS[word]] + [len(words)]:
        out += range(last + PIECE_MOST, i, PIECE_MOST)
        if i > last:
            out.append(i)
            last = i
    return out


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "piece") -> DataFrame:
    """``(KEY, no, start, end, words, digest)`` of every unit, in code points. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["KEY", "no", "start", "end", "words", "digest"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(k, no, *found) for no, found in enumerate(cut(t.as_py() or "", unit))]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, FOUND)


def runs(found: DataFrame) -> DataFrame:
    """Repeated units that follow one another in a text, joined: ``(KEY, start, end, words)`` and, for the first and
    the last unit, the key and place of its kept occurrence (``at_start``, ``at_end``)."""
    keepers = found.groupBy("digest").agg(F.min(F.struct("KEY", "start", "end")).alias("kept"), F.count("*").alias("n"))
    keepers = stored(keepers.filter("n > 1").select("digest", "kept"), "keepers")
    met = found.join(keepers, "digest").filter(~F.struct("KEY", "start").eqNullSafe(F.struct("kept.KEY", "kept.start")))
    # rows that repeat a key and a text fall together here: they cannot be told apart
    met = met.select("KEY", "no", "start", "end", "words", "kept").dropDuplicates(["KEY", "no", "start", "end"])
    run = F.col("no") - F.row_number().over(W.partitionBy("KEY").orderBy("no", "start"))
    joined = met.withColumn("run", run).groupBy("KEY", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
        F.min_by(F.struct("kept.KEY", "kept.start"), "start").alias("at_start"), F.max_by(F.struct("kept.KEY", "kept.end"), "end").alias("at_end"))
    return joined.drop("run")


def _agreeing(left: bool):
    """Characters and words that two texts share where they meet a run, whole words only, over blanks of any kind."""

    @F.pandas_udf("chars int, words int")
    def agreeing(own, kept):
        import pandas as pd

        rows = []
        for a, b in zip(own, kept):
            x, y = ([(w.start(), w.end(), w[0].lower()) for w in WORD.finditer(t or "")] for t in (a, b))
            if left:  # a cut word at the far end is no whole word; one that touches the run has no blank before it
                x, y = x[::-1][:len(x) - (len(a or "") >= REACH)], y[::-1][:len(y) - (len(b or "") >= REACH)]
            else:
                x, y = x[:len(x) - (len(a or "") >= REACH)], y[:len(y) - (len(b or "") >= REACH)]
            n = next((i for i, (v, w) in enumerate(zip(x, y)) if v[2] != w[2]), min(len(x), len(y)))
            rows.append((0, 0) if not n else (len(a) - x[n - 1][0] if left else x[n - 1][1], n))
        return pd.DataFrame(rows, columns=["chars", "words"])

    return agreeing


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "piece", run_words: int = RUN_WORDS,
            core_words: int = CORE_WORDS) -> DataFrame:
    """Spans to remove: ``(key, start, end, kept_<key>, kept_start)``, with the place that keeps the span's first unit.

    Ranks go by key, a null first, then by place. A run inside one document goes there too, but for its first occurrence.
    Rows that repeat a key cannot be told apart by their spans; of a null key none is removed, though it may keep a unit.
    Runs whose units hold fewer than ``core_words`` words are not lengthened, and no end by more than ``REACH`` characters.
    Other columns are not looked at.
    """
    found = stored(units(docs, key, text, unit), "units")
    joined = runs(found).filter(F.col("KEY").isNotNull() & (F.col("words") >= core_words))
    joined = stored(joined, "runs")
    texts = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))

    before, behind = F.col("before").isNotNull(), F.col("behind").isNotNull()
    given = F.struct(
        F.when(before, F.substring("t", F.greatest(F.col("before") - REACH, F.lit(0)) + 1, F.least("before", F.lit(REACH)))).alias("before"),
        F.when(behind, F.substring("t", F.col("behind") + 1, F.lit(REACH))).alias("behind"))
    none = F.lit(None).cast("int")
    own = joined.select(F.col("KEY").alias("at"), F.col("start").alias("before"), F.col("end").alias("behind"))
    left = joined.select(F.col("at_start.KEY").alias("at"), F.col("at_start.start").alias("before"), none.alias("behind"))
    right = joined.select(F.col("at_end.KEY").alias("at"), none.alias("before"), F.col("at_end.end").alias("behind"))
    # copies of one text ask for the same places of the kept one: each is looked up once
    asked = own.unionByName(left).unionByName(right).distinct()
    around = texts.join(asked, F.col("k").eqNullSafe(F.col("at"))).select("at", "before", "behind", given.alias("given"))
    around = stored(around.dropDuplicates(["at", "before", "behind"]), "around")

    def looked_up(rows: DataFrame, name: str, at: Column, before: Column | None, behind: Column | None) -> DataFrame:
        kind = (F.col("before").isNotNull() == F.lit(before is not None)) & (F.col("behind").isNotNull() == F.lit(behind is not None))
        other = around.filter(kind).select(F.col("at").alias("a1"), F.col("before").alias("a2"), F.col("behind").alias("a3"), F.col("given").alias(name))
        same = at.eqNullSafe(F.col("a1"))
        for wanted, had in ((before, "a2"), (behind, "a3")):
            same = same & (wanted == F.col(had)) if wanted is not None else same
        return rows.join(other, same).drop("a1", "a2", "a3")

    met = looked_up(joined, "own", F.col("KEY"), F.col("start"), F.col("end"))
    met = looked_up(met, "kept_left", F.col("at_start.KEY"), F.col("at_start.start"), None)
    met = looked_up(met, "kept_right", F.col("at_end.KEY"), None, F.col("at_end.end"))
    met = met.select(
        "KEY", "start", "end", "words", "at_start", _agreeing(True)("own.before", "kept_left.before").alias("l"),
        _agreeing(False)("own.behind", "kept_right.behind").alias("r"))
    whole = met.filter(F.col("words") + F.col("l.words") + F.col("r.words") >= run_words)
    whole = whole.select("KEY", (F.col("start") - F.col("l.chars")).alias("start"), (F.col("end") + F.col("r.chars")).alias("end"), "at_start")
    # lengthened runs can touch or overlap
    by = W.partitionBy("KEY").orderBy("start", "end")
    apart = F.coalesce(F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)) < F.col("start"), F.lit(True))
    whole = whole.withColumn("span", F.sum(apart.cast("int")).over(by)).groupBy("KEY", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("at_start", F.struct("start", "end")).alias("kept"))
    return whole.select(F.col("KEY").alias(key), "start", "end", F.col("kept.KEY").alias(f"kept_{key}"), F.col("kept.start").alias("kept_start"))


def remove(text: Column, spans: Column) -> Column:
    """The text without the sorted, disjoint spans ``array<struct<start, end>>``; null spans remove nothing."""
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(begins, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "piece", run_words: int = RUN_WORDS,
                 core_words: int = CORE_WORDS) -> DataFrame:
    """The documents with repeated runs cut out, and ``removed``, their places in the original text."""
    places = repeats(docs, key, text, unit, run_words, core_words).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    places = places.withColumnRenamed(key, "line_dedup_key")
    met = docs.drop("removed").join(stored(places, "removed"), F.col(key) == F.col("line_dedup_key"), "left").drop("line_dedup_key")
    return met.withColumn(text, remove(F.col(text), F.col("removed")))
