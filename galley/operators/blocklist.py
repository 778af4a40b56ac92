"""Block lists of any size, found in texts by automata of rare windows.

A phrase of more than 16 characters is looked for by one window of 16, the one least likely to stand in the corpus at hand;
a shorter one by itself. The windows become flat automata that are walked over slices of texts. Where one is met the rest of
the phrase is compared in place. No row is made per pair of text and phrase, and nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.operators.joins import widen
from galley.operators.segment import Automaton, walk
from galley.session import cut_lineage

#: Characters of a window, characters of the grams that tell how common it is, and counters of grams.
WINDOW_CHARS, GRAM_CHARS, COUNTERS = 16, 4, 1 << 16
#: Bytes of phrases in one automaton, and automata that one pass over the texts holds.
BLOCK_BYTES, PASS_BLOCKS = 8 << 20, 4


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _gram_counters(text: str) -> np.ndarray:
    """The counter of the gram at each place of a text."""
    codes = _codes(text)
    if len(codes) < GRAM_CHARS:
        return np.empty(0, np.int64)
    mixed = np.zeros(len(codes) - GRAM_CHARS + 1, np.uint64)
    for i in range(GRAM_CHARS):
        mixed = (mixed + codes[i:i + len(mixed)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64)


def gram_table(df: DataFrame, text: str) -> np.ndarray:
    """How often the grams of each counter stand in a column; every task folds its texts to one row per counter."""

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch["t"].dropna():
                seen += np.bincount(_gram_counters(t), minlength=COUNTERS)
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"counter": used, "n": seen[used]})

    counted = df.select(F.col(text).cast("string").alias("t")).mapInPandas(count, "counter BIGINT, n BIGINT")
    table = np.zeros(COUNTERS, np.int64)
    for counter, n in counted.groupBy("counter").agg(F.sum("n")).collect():  # COUNTERS rows at most
        table[counter] = n
    return table


def rarest_window(phrase: str, table: np.ndarray) -> int:
    """Start of the window with the least common gram: a window is no more common than any of its grams."""
    counts = table[_gram_counters(phrase)]
    width = WINDOW_CHARS - GRAM_CHARS + 1
    return int(np.lib.stride_tricks.sliding_window_view(counts, width).min(axis=1).argmin())


class PhraseFinder:
    """Phrases behind one automaton: short ones whole, long ones by a window and what surrounds it."""

    def __init__(self, phrases: Iterable[str], table: np.ndarray):
        whole, self.around = set(), {}
        for phrase in phrases:
            if len(phrase) <= WINDOW_CHARS:
                whole.add(phrase)
            else:
                at = rarest_window(phrase, table)
                self.around.setdefault(phrase[at:at + WINDOW_CHARS], []).append((at, phrase))
        for window in list(self.around):
            # a text with this window holds a shorter phrase anyhow; and the longest find at a place must not hide one
            if any(window[:n] in whole for n in range(1, WINDOW_CHARS + 1)):
                del self.around[window]
        self.automaton = Automaton([*whole, *self.around])

    def holds(self, text: str, longest: np.ndarray) -> bool:
        """Whether a text holds any phrase, given the longest window at each of its places."""
        for at in np.flatnonzero(longest).tolist():
            behind = self.around.get(text[at:at + longest[at]], ())
            if not behind or any(at >= start and text.startswith(p, at - start) for start, p in behind):
                return True
        return False


def phrase_finders(phrases: DataFrame, phrase: str, table: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Iterator[PhraseFinder]:
    """Finders of bounded size that together hold all phrases. Nulls, empty phrases and repeats change nothing."""
    listed = phrases.select(F.col(phrase).cast("string").alias("p")).filter("p != ''").distinct()
    size = listed.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    parts = -(-size // block_bytes)
    own = F.pmod(F.xxhash64("p"), F.lit(max(parts, 1)))
    for part in range(parts):
        yield PhraseFinder((r[0] for r in listed.filter(own == part).toLocalIterator()), table)


def _found(held: list) -> Column:
    @F.pandas_udf("boolean")
    def found(texts):
        import pandas as pd

        known = texts.dropna()
        blocked = np.zeros(len(known), bool)
        for finder in (h.value for h in held):
            left = np.flatnonzero(~blocked)
            walked = walk(known.iloc[left].tolist(), [finder.automaton])
            for i, (text, longest) in zip(left.tolist(), walked):
                blocked[i] = finder.holds(text, longest)
        return pd.Series(blocked, index=known.index).reindex(texts.index, fill_value=False)

    return found


def mark_blocked(df: DataFrame, text: str, phrases: DataFrame, phrase: str = "phrase", flag: str = "blocked",
                 block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """``df`` with a flag for the rows whose text holds any phrase, judged row by row; a null text holds none.

    A list beyond ``pass_blocks`` automata takes several passes, so that what a worker holds stays bounded.
    """
    df = widen(df)
    finders = phrase_finders(phrases, phrase, gram_table(df, text), block_bytes)
    out, held, blocked = df, [], F.lit(False)
    for finder in finders:
        if len(held) == pass_blocks:
            out, held = cut_lineage(out.withColumn(flag, blocked | _found(held)(F.col(text).cast("string")))), []
            blocked = F.col(flag)
        held.append(df.sparkSession.sparkContext.broadcast(finder))
    return out.withColumn(flag, blocked | _found(held)(F.col(text).cast("string")) if held else blocked)
