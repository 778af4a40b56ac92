"""CJK words and syllables by lookup tables.

A table of words becomes automata: tries as flat sorted arrays of transitions, each of a bounded number of bytes. They
are walked over all places of a slice of texts at once, so a text costs its length, whatever the size of the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.text import CJK_CLASS
from galley.operators.joins import small_broadcast, spread

#: Bytes of words that one automaton holds at most; a larger table is dealt to several.
AUTOMATON_BYTES = 8 << 20
#: Characters of texts that are walked together, and a code that no text has, set between them.
SLICE_CHARS, APART = 1 << 18, (1 << 21) - 1
#: Characters at the start of words that are marked, and the number of bits of a mark.
HEAD_CHARS, HEAD_BITS = 4, 18
_CJK = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK_CLASS)  # as Python writes the class
_WORD = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}])\w)+")
_RUN = re.compile(rf"[{_CJK}]|[^{_CJK}]+")
_LATIN = r"[\p{L}\p{N}_&&[^%s]]+" % CJK_CLASS


class Automaton:
    """Transitions ``state * 2**21 + character`` in ascending order, the states they lead to, and the states that end a word."""

    def __init__(self, words: Iterable[str]):
        words, moves = list(words), {}
        ends = set()
        for word in words:
            state = 0
            for ch in word:
                state = moves.setdefault(state << 21 | ord(ch), len(moves) + 1)
            ends.add(state)
        self.moves = np.fromiter(moves, np.int64, len(moves))
        order = np.argsort(self.moves)
        self.moves, self.to = self.moves[order], np.fromiter(moves.values(), np.int32, len(moves))[order]
        self.ends = np.zeros(len(moves) + 1, bool)
        self.ends[list(ends)] = True
        self.ends[0] = False
        # marks of how words begin, by as many characters as all have, rule out most places before any is walked
        self.head = min((len(w) for w in words if w), default=0)
        self.head = min(self.head, HEAD_CHARS)
        self.heads = np.zeros(1 << HEAD_BITS, bool)
        for start in {w[:self.head] for w in words if w}:
            self.heads[self._marks(np.array([ord(ch) for ch in start], np.uint32))] = True

    def _marks(self, codes: np.ndarray) -> np.ndarray:
        """The mark of the first characters of a word at each place that has as many."""
        places = len(codes) - self.head + 1
        mixed = np.zeros(max(places, 0), np.uint32)
        for i in range(self.head if places > 0 else 0):
            mixed = (mixed + codes[i:i + places]) * np.uint32(0x9E3779B1)
        return mixed >> np.uint32(32 - HEAD_BITS)

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """At each place the length of the longest word that begins there, zero where none does."""
        found = np.zeros(len(codes), np.int32)
        at = np.flatnonzero(self.heads[self._marks(codes)]) if self.head else np.empty(0, np.int64)
        state, depth = np.zeros(len(at), np.int64), 0
        while len(at) and len(self.moves):
            inside = at + depth < len(codes)
            at, state = at[inside], state[inside]
            wanted = state << 21 | codes[at + depth].astype(np.int64)
            place = np.minimum(np.searchsorted(self.moves, wanted), len(self.moves) - 1)
            hit = self.moves[place] == wanted
            at, state, depth = at[hit], self.to[place[hit]].astype(np.int64), depth + 1
            found[at[self.ends[state]]] = depth
        return found


def walk(texts: list[str], automata: list[Automaton]) -> Iterator[tuple[str, np.ndarray]]:
    """Each text with the length of the longest word at each of its places."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < SLICE_CHARS):
            size, end = size + len(texts[end]) + 1, end + 1
        codes = [np.r_[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), np.uint32(APART)] for t in texts[at:end]]
        joined = np.concatenate(codes)
        lengths = automata[0].longest(joined)
        for other in automata[1:]:
            lengths = np.maximum(lengths, other.longest(joined))
        begin = 0
        for text, code in zip(texts[at:end], codes):
            yield text, lengths[begin:begin + len(text)]
            begin += len(code)
        at = end


def longest_words(texts: list[str], automata: list[Automaton]) -> Iterator[tuple[str, list[int]]]:
    """As ``walk``, in lists, which are faster to read place by place."""
    return ((text, lengths.tolist()) for text, lengths in walk(texts, automata))


def cut(text: str, longest: list[int], other: re.Pattern) -> list[str]:
    """Forward maximum matching: the longest word at a place, else what the pattern finds there, else nothing."""
    out, i = [], 0
    while i < len(text):
        if longest[i]:
            end = i + longest[i]
        elif found := other.match(text, i):
            end = found.end()
        else:
            i += 1
            continue
        out.append(text[i:end])
        i = end
    return out


def cut_around(text: str, longest: list[int]) -> list[str]:
    """All of the text: the longest word at a place, else a CJK character, else a run of others up to the next word."""
    out, i = [], 0
    while i < len(text):
        end = i + longest[i]
        if end == i:
            stop = _RUN.match(text, i).end()
            end = next((j for j in range(i + 1, stop) if longest[j]), stop)
        out.append(text[i:end])
        i = end
    return out


def build_automata(words: DataFrame, column: str = "term", block_bytes: int = AUTOMATON_BYTES) -> list[Automaton]:
    """Automata that together hold all words of a column. Nulls, empty words and repeats change nothing."""
    terms = words.select(F.col(column).alias("term")).filter("term != ''").distinct()
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    own = F.pmod(F.xxhash64("term"), F.lit(parts))
    return [Automaton(r[0] for r in terms.filter(own == part).toLocalIterator()) for part in range(parts)]


def _cutter(spark: SparkSession, automata: list[Automaton], how: Callable[[str, list[int]], list[str]]) -> Callable[[Column], Column]:
    held = [spark.sparkContext.broadcast(a) for a in automata]  # each of bounded size

    @F.arrow_udf("array<string>")
    def tokens(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        # tokens become Arrow arrays slice by slice: as objects, those of a whole batch take many times its bytes
        kind, known, begin = pa.list_(pa.string()), texts.drop_null(), 0
        sizes, made = pc.utf8_length(known).to_numpy(zero_copy_only=False), []
        slices = np.cumsum(sizes) // SLICE_CHARS
        for end in np.append(np.flatnonzero(np.diff(slices)) + 1, len(known)).tolist():
            some = known.slice(begin, end - begin).to_pylist()
            made.append(pa.array([how(t, n) for t, n in longest_words(some, [a.value for a in held])], kind))
            begin = end
        if texts.null_count == 0:
            return pa.concat_arrays(made)
        there = texts.is_valid().to_numpy(zero_copy_only=False)
        at = np.where(there, np.cumsum(there) - 1, 0)
        return pa.concat_arrays(made).take(pa.array(at, mask=~there))

    return tokens


def segmenter(spark: SparkSession, dictionary: DataFrame | list[str] | None) -> Callable[[Column], Column]:
    """A function from a text to its tokens: lower case, phrases of the dictionary ``(term)`` never split.

    Forward maximum matching; where no phrase fits, one CJK character or a run of letters and digits. Without a dictionary
    nothing leaves the JVM. A null text has null tokens.
    """
    if isinstance(dictionary, list):
        dictionary = spark.createDataFrame([(w,) for w in dictionary], "term STRING") if dictionary else None
    if dictionary is None:
        pattern = f"([{CJK_CLASS}]|{_LATIN})"
        return lambda text: F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    tokens = _cutter(spark, build_automata(dictionary.select(F.lower("term").alias("term"))), lambda t, n: cut(t, n, _WORD))
    return lambda text: tokens(F.lower(text))


def segment_cjk(df: DataFrame, column: str, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, terms)`` with dictionary phrases never split. Rows are cut one by one: keys may repeat or be null."""
    return df.select(key, segmenter(df.sparkSession, dictionary)(F.col(column)).alias("terms"))


def transliterate(df: DataFrame, column: str, syllables: DataFrame, key: str) -> DataFrame:
    """``(key, syllables)``: phrases and CJK characters by their syllables, other runs as they are, joined by '-'.

    ``syllables`` is ``(ch, syllable)``; an entry of several characters is the reading of a phrase, and the longest entry
    at a place wins, so that a character can read differently by phrase. Characters without an entry stay. ``key`` is unique;
    of several readings of one entry the least counts.
    """
    table = syllables.groupBy("ch").agg(F.min("syllable").alias("syllable"))
    phrases = table.filter("syllable IS NOT NULL")
    if phrases.filter(F.length("ch") > 1).isEmpty():
        parts = F.regexp_extract_all(F.col(column), F.lit(f"([{CJK_CLASS}]|[^{CJK_CLASS}]+)"), F.lit(1))
    else:
        parts = _cutter(df.sparkSession, build_automata(phrases, "ch"), cut_around)(F.col(column))
    rows = spread(df, key).select(key, F.posexplode(parts).alias("pos", "ch"))
    named = rows.join(small_broadcast(table), "ch", "left")
    return named.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", F.coalesce("syllable", "ch").alias("s")))), lambda x: x["s"]
            ),
            "-",
        ).alias("syllables")
    )
