"""Benchmark decontamination by SimHash over windows of the items' sizes.

A window of as many words as an item is fingerprinted over its five-word shingles, each bit set where more than
half of the shingles' hashes have it. Items of a size are indexed by ``radius + 1`` blocks of bits: a window within
``radius`` bits of an item agrees with it on at least one whole block, so looking up every block finds all such
pairs. Candidates are then verified by the exact weighted similarity of their shingles, each weighted by how
often it occurs: the sum of the smaller counts over the sum of the larger.

Only windows that hold at least one shingle of an item of their size are fingerprinted; the others have similarity 0 to
all of them, whatever their bits. A window's bit counts are differences of running sums, so it costs the same
at any size.

Documents stay where they are: nothing is shuffled. Items are sent to the tasks in blocks of at most
``ITEM_ROWS`` items and ``ITEM_BYTES`` bytes; a larger benchmark takes several passes over the documents.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 16
ITEM_ROWS, ITEM_BYTES = 50_000, 64 << 20
LEAKS = "KEY BIGINT, item_id BIGINT, start INT, end INT, similarity DOUBLE"
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ values >> np.uint64(shift)) * np.uint64(factor)
    return values ^ values >> np.uint64(31)


def runs(values: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` values."""
    n = len(values) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * STEP + values[k:k + n]
    return out


def window_prints(words: list[str], starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` words at the sorted starts."""
    shingle = min(SHINGLE, size)
    a, b = int(starts[0]), int(starts[-1]) + size
    numbers = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words[a:b]], np.uint64)
    hashes = mixed(runs(numbers, shingle))
    count = size - shingle + 1
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    held = sums[starts - a + count] - sums[starts - a]
    return np.packbits(2 * held > count, axis=1, bitorder="little").view("<u8")[:, 0]


def shingle_counts(words: list[str], start: int, size: int) -> Counter:
    shingle = min(SHINGLE, size)
    return Counter(tuple(words[i:i + shingle]) for i in range(start, start + size - shingle + 1))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def is_free(placed: list[int], start: int, size: int) -> bool:
    """Whether a window overlaps none of the windows of its size that begin at the sorted places."""
    at = bisect_left(placed, start)
    return (at == 0 or start - placed[at - 1] >= size) and (at == len(placed) or placed[at] - start >= size)


class BlockIndex:
    """Multi-index of the fingerprints of items of one size."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.tables = []
        for a, b in zip(cuts, cuts[1:]):
            mask = np.uint64((1 << b - a) - 1)
            values = prints >> np.uint64(a) & mask
            order = np.argsort(values, kind="stable")
            self.tables.append((np.uint64(a), mask, values[order], order))

    def within(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows and items at most ``radius`` bits apart, closest first."""
        found = np.empty(0, np.int64)
        for shift, mask, values, order in self.tables:
            wanted = windows >> shift & mask
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            sizes = high - low
            window = np.repeat(np.arange(len(windows)), sizes)
            item = order[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(window))]
            near = np.bitwise_count(windows[window] ^ self.prints[item]) <= self.radius
            found = np.union1d(found, window[near] * len(self.prints) + item[near])
        window, item = np.divmod(found, len(self.prints))
        order = np.argsort(np.bitwise_count(windows[window] ^ self.prints[item]), kind="stable")
        return window[order], item[order]


class Scanner:
    """A block of items, ready to be found in texts."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = SIMILARITY, radius: int = RADIUS):
        self.threshold = threshold
        split = [(item_id, words_of(text or "")) for item_id, text in items]
        split = [(item_id, words) for item_id, words in split if words]
        self.known = {w: i for i, w in enumerate({w for _, ws in split for w in ws}, 1)}
        self.by_size: dict[int, tuple] = {}
        self.anchors: dict[int, tuple[np.ndarray, list[set[int]]]] = {}  # by shingle size: run numbers, sizes of their items
        by_size: dict[int, list] = {}
        for item_id, words in split:
            by_size.setdefault(len(words), []).append((item_id, words))
        anchors: dict[int, dict[int, set[int]]] = {}
        for size, same in by_size.items():
            prints = np.array([window_prints(ws, np.zeros(1, np.int64), size)[0] for _, ws in same], np.uint64)
            self.by_size[size] = ([i for i, _ in same], [shingle_counts(ws, 0, size) for _, ws in same], BlockIndex(prints, radius))
            shingle = min(SHINGLE, size)
            for _, words in same:
                for number in runs(self._numbers(words), shingle).tolist():
                    anchors.setdefault(shingle, {}).setdefault(number, set()).add(size)
        for shingle, sizes in anchors.items():
            numbers = np.array(sorted(sizes), np.uint64)
            self.anchors[shingle] = numbers, [sizes[n] for n in numbers.tolist()]

    def _numbers(self, words: list[str]) -> np.ndarray:
        get = self.known.get
        return np.array([get(w, 0) for w in words], np.uint64)

    def _starts(self, n: int, numbers: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the windows to look at, by their size."""
        hits: dict[int, list[int]] = {}
        for shingle, (known, sizes) in self.anchors.items():
            found = runs(numbers, shingle)
            inside = np.ones(len(found), bool)
            for k in range(shingle if len(found) else 0):
                inside &= numbers[k:k + len(found)] != 0
            at = np.flatnonzero(inside)
            place = np.minimum(np.searchsorted(known, found[at]), len(known) - 1)
            match = known[place] == found[at]
            for p, q in zip(at[match].tolist(), place[match].tolist()):
                for size in sizes[q]:
                    hits.setdefault(size, []).append(p)
        out = {}
        for size, places in hits.items():
            shingle, last = min(SHINGLE, size), n - size
            if last < 0:  # the whole text is smaller than the item
                out[size] = np.zeros(1, np.int64)
                continue
            edge = np.zeros(last + 2, np.int64)
            p = np.array(places)
            np.add.at(edge, np.clip(p - (size - shingle), 0, last), 1)
            np.add.at(edge, np.clip(p, 0, last) + 1, -1)
            out[size] = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        return out

    def _windows(self, words: list[str]) -> Iterator[tuple[int, int, int, int, float]]:
        """``(size, item, first word, words, similarity)`` of the windows that are similar enough to an item.

        Fingerprints that agree come first, so windows over words that an item already has to the letter are passed over.
        """
        for size, starts in self._starts(len(words), self._numbers(words)).items():
            _, counts, index = self.by_size[size]
            taken = min(size, len(words))
            exact: dict[int, list[int]] = {}
            window, item = index.within(window_prints(words, starts, taken))
            for w, i in zip(window.tolist(), item.tolist()):
                start, placed = int(starts[w]), exact.setdefault(i, [])
                if is_free(placed, start, taken):
                    score = similarity(shingle_counts(words, start, taken), counts[i])
                    if score == 1.0:
                        insort(placed, start)
                    if score >= self.threshold:
                        yield size, i, start, taken, score

    def find(self, text: str) -> list[tuple[int | None, int, int, float]]:
        """``(item_id, first word, words, similarity)``: every place where a text holds an item.

        Of overlapping windows the most similar one counts, then the first.
        """
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for size, i, start, taken, score in self._windows(words_of(text)):
            found.setdefault((size, i), []).append((-score, start, taken))
        out = []
        for (size, i), windows in found.items():
            placed: list[int] = []
            for score, start, taken in sorted(windows):
                if is_free(placed, start, taken):
                    insort(placed, start)
                    out.append((self.by_size[size][0][i], start, taken, -score))
        return out

    def holds(self, text: str) -> bool:
        """Whether a text holds any item."""
        return next(self._windows(words_of(text)), None) is not None


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, each small enough to be sent to every task."""
    rows = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    blocks = max(1, -(-count // (ITEM_ROWS // 2)), -(-(size or 0) // (ITEM_BYTES // 2)))
    for i in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == i)
        yield [(r["k"], r["t"]) for r in part.toLocalIterator()]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY,
          radius: int = RADIUS) -> DataFrame:
    """``(key, item_id, start, end, similarity)``: every place where a document holds an item.

    Of overlapping windows of an item the most similar one counts, then the first; other places are rows of their own.
    Places are code points of the original text. Words are lower-cased runs of anything but white space. Null and
    empty texts hold nothing, and empty items are found nowhere; a text shorter than an item is one window. Repeated
    rows are reported each. An item of fewer than five words is one shingle, found wherever its words stand together.
    """
    given = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for block in item_blocks(items):
        out = out.unionByName(given.mapInArrow(_find_leaks(_sent(items, block), threshold, radius), LEAKS))
    return out.withColumnRenamed("KEY", key)


def _find_leaks(sent, threshold: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent, threshold, radius)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                found = scanner.find(t)
                if found:
                    places = [m.span() for m in re.finditer(r"\S+", t)]
                    rows += [(k, i, places[a][0], places[a + n - 1][1], s) for i, a, n, s in found]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds)],
                                             ["KEY", "item_id", "start", "end", "similarity"])

    return run


def is_leaked(text: Column, items: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> Column:
    """True for texts that hold an item."""
    found = F.lit(False)
    for block in item_blocks(items):
        found = found | _holds(_sent(items, block), threshold, radius)(text)
    return found


def _holds(sent, threshold: float, radius: int):
    @F.pandas_udf("boolean")
    def holds(texts):
        import pandas as pd

        scanner = _scanner(sent, threshold, radius)
        return pd.Series([bool(t) and scanner.holds(t) for t in texts], dtype=bool)

    return holds


def _sent(items: DataFrame, block: list[tuple]):
    """A block of items at every executor, under a name of its own."""
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(block)


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(sent, threshold: float, radius: int) -> Scanner:
    """The scanner a worker built last, kept over its tasks."""
    name, block = sent
    key = name, threshold, radius
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(block.value, threshold, radius)
    return _SCANNERS[key]
