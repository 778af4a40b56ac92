"""Byte-pair encoding with a contiguous rank array.

A text is cut into words by the vocabulary's pattern. A short word holds the positions where its parts
begin and, beside them, the rank of merging each part with its right neighbour. The smallest rank is found
by a scan, its boundary deleted and the two ranks next to it refreshed, until no merge is left: for the few
bytes of a word that beats any linked structure. Long words (above ``SHORT_WORD`` bytes) take the same
merges in the same order from a heap, so that one very long word costs n log n.

Encoding needs no shuffle: rows stream through Python workers in Arrow batches, each task with a bounded
cache of words.
"""

from __future__ import annotations

import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

SHORT_WORD = 512
CACHED_WORDS = 300_000
# The public word pattern of byte-level vocabularies.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_MERGE = 1 << 60
SLICE_CHARS = 2_000_000
CUT = "\ud800"  # no valid text holds a lone surrogate


def byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte in vocabulary files: itself if visible, else the next letter from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        model = spec["model"]
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.letter_ids = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.ranks: dict[int, int] = {}  # of a pair of ids, packed into one number
        self.merged: list[int] = []  # id that the merge of each rank makes
        for rank, merge in enumerate(model["merges"]):
            left, right = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            self.ranks.setdefault(self.ids[left] << 32 | self.ids[right], rank)
            self.merged.append(self.ids[left + right])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in self.ids.items():
            self.tokens[i] = token
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.words = regex.compile(WORDS)
        self.control = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.table = _PairTable(self.ranks)
        self.letters = np.array(self.letter_ids)
        self.made = np.array(self.merged or [0])
        self.marks = {m: self.ids[m.encode()].to_bytes(4, "little") for m in ".,;:!?" if m.encode() in self.ids}
        self.known: dict[str, bytes | None] = {}  # ids of chunks; None where a chunk leaves the next cut open

    # one word -----------------------------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        return self._short(word)[1] if len(word) <= SHORT_WORD else self._long(word)[1]

    def _short(self, word: bytes) -> tuple[list[int], list[int]]:
        """Part boundaries and the parts' ids after all merges, by repeated scans of the rank array."""
        get, merged, letter = self.ranks.get, self.merged, self.letter_ids
        bounds = [*range(len(word) + 1)]
        ids = [letter[b] for b in word]
        ranks = [get(a << 32 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_MERGE:
                break
            i = ranks.index(least)
            new = ids[i] = merged[least]
            del bounds[i + 1], ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | new, NO_MERGE)
            if i < len(ranks):
                ranks[i] = get(new << 32 | ids[i + 1], NO_MERGE)
        return bounds, ids

    def _long(self, word: bytes) -> tuple[list[int], list[int]]:
        """The same parts from a heap of (rank, place); an entry whose ids have changed is stale."""
        size = len(word)
        ids = [self.letter_ids[b] for b in word]  # of the part that begins here, -1 where none does
        after = [*range(1, size + 1)]  # end of the part that begins here
        before = [*range(-1, size - 1)]  # begin of the part to the left
        heap = []

        def offer(a: int) -> None:
            if a >= 0 and after[a] < size:
                pair = ids[a] << 32 | ids[after[a]]
                rank = self.ranks.get(pair)
                if rank is not None:
                    heapq.heappush(heap, (rank, a, pair))

        for a in range(size):
            offer(a)
        while heap:
            rank, a, pair = heapq.heappop(heap)
            b = after[a]
            if ids[a] < 0 or b == size or ids[a] << 32 | ids[b] != pair:
                continue
            ids[a], ids[b], after[a] = self.merged[rank], -1, after[b]
            if after[a] < size:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        begins = [a for a in range(size) if ids[a] >= 0]
        return begins + [size], [ids[a] for a in begins]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of many short words (none empty), whose rank arrays lie end to end.

        Each round takes in every open word the smallest rank, deletes its boundary and refreshes the ranks
        beside it; a word without a merge left is closed.
        """
        sizes = np.array([*map(len, words)])
        ids = self.letters[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(len(words))  # of each open word in the input
        ends = np.cumsum(sizes)
        ranks = np.full(len(ids), NO_MERGE)
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        ranks[at] = self.table.find(ids[at], ids[at + 1])
        closed: list[bytes] = [b""] * len(words)
        while len(place):
            starts = ends - sizes
            least = np.minimum.reduceat(ranks, starts)
            opened = least != NO_MERGE
            if not opened.all():
                data = ids.astype("<i4").tobytes()
                for w, a, b in zip(place[~opened].tolist(), (4 * starts[~opened]).tolist(), (4 * ends[~opened]).tolist()):
                    closed[w] = data[a:b]
                stay = np.repeat(opened, sizes)
                ids, ranks, sizes, place, least = ids[stay], ranks[stay], sizes[opened], place[opened], least[opened]
                ends = np.cumsum(sizes)
                if not len(place):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            owner = np.searchsorted(ends, hits, "right")
            first = hits[np.r_[True, owner[1:] != owner[:-1]]]  # leftmost of each word
            ids[first] = self.made[least]
            stay = np.ones(len(ids), bool)
            stay[first + 1] = False
            ids, ranks = ids[stay], ranks[stay]
            first -= np.arange(len(first))  # one boundary less in each word before
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            ranks[first] = NO_MERGE
            right = first[first != ends - 1]
            ranks[right] = self.table.find(ids[right], ids[right + 1])
            left = first[first != ends - sizes] - 1
            ranks[left] = self.table.find(ids[left], ids[left + 1])
        return closed

    # texts --------------------------------------------------------------------------------------

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of chunks, each without blanks or line ends but at its begin, into the cache."""
        known = self.known
        if len(known) + len(chunks) > CACHED_WORDS:
            known.clear()
        words, marked, others = [], [], []
        for chunk in chunks.difference(known):
            if (chunk[1:] if chunk[:1] == " " else chunk).isalpha():
                words.append(chunk)
            elif not chunk or chunk[-1].isspace():
                known[chunk] = None if chunk else b""
            elif chunk[-1] in self.marks and chunk[-2:-1].isalpha() and (
                    chunk[1:-1] if chunk[0] == " " else chunk[:-1]).isalpha():
                marked.append(chunk)
            else:
                others.append((chunk, self.words.findall(chunk)))
        words += {c[:-1] for c in marked}.difference(known, words)
        words += {w for _, ws in others for w in ws if known.get(w) is None}.difference(words)
        found = self.merge_words(words)
        for chunk, ws in others:
            known[chunk] = b"".join([found[w] if w in found else known[w] for w in ws])
        for word in [w for w in found if w[-1].isspace()]:
            del found[word]  # as a chunk it leaves the next cut open
        known.update(found)
        for chunk in marked:
            known[chunk] = known[chunk[:-1]] + self.marks[chunk[-1]]

    def merge_words(self, words) -> dict[str, bytes]:
        short = [w for w in words if len(w) * 4 <= SHORT_WORD]
        found = dict(zip(short, self.merge_many([w.encode() for w in short]))) if short else {}
        if len(short) < len(words):
            for word in words:
                if word not in found:
                    found[word] = array("i", self.merge(word.encode())).tobytes()
        return found

    def _by_pattern(self, text: str) -> list[bytes]:
        words = self.words.findall(text)
        found = self.merge_words({*words})
        return [found[w] for w in words]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of several texts, whose chunks are looked up together.

        A blank or line end after anything but white space always begins a word, so chunks cut there are
        encoded as they stand; a text where white space meets is cut by the pattern alone.
        """
        pieces: list[list] = []  # by text: ids of control strings, and (text, chunks) of what is between
        for text in texts:
            parts = self.control.split(text) if self.control is not None and self.control.search(text) else [text]
            pieces.append([self.added[p].to_bytes(4, "little") if p in self.added else (
                p, p.replace(" ", CUT + " ").replace("\n", CUT + "\n").split(CUT)) for p in parts])
        self.learn(set().union(*[p[1] for parts in pieces for p in parts if type(p) is tuple]))
        known, out = self.known, []
        for parts in pieces:
            ids: list[bytes] = []
            for part in parts:
                if type(part) is bytes:
                    ids.append(part)
                    continue
                text, chunks = part
                found = [*map(known.__getitem__, chunks)]
                if None in found:
                    at = found.index(None)
                    found = self._by_pattern(text) if at < len(found) - 1 else found[:-1] + self._by_pattern(chunks[-1])
                ids += found
            out.append(np.frombuffer(b"".join(ids), "<i4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class _PairTable:
    """Ranks of id pairs in an open-addressing table, looked up many at a time."""

    def __init__(self, ranks: dict[int, int]):
        self.bits = max(10, (4 * len(ranks)).bit_length())
        self.keys = np.full(1 << self.bits, -1)
        self.ranks = np.full(1 << self.bits, NO_MERGE)
        keys = np.array([*ranks.keys()], np.int64)
        values = np.array([*ranks.values()], np.int64)
        slots = self._slots(keys)
        while len(keys):  # of those that want a free slot the first takes it, the others move on
            free = self.keys[slots] == -1
            taken, first = np.unique(slots[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[taken], self.ranks[taken] = keys[chosen], values[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (1 << self.bits) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slots = self._slots(keys)
        out = np.full(len(keys), NO_MERGE)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slots]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slots[hit]]
            go = ~hit & (there != -1)
            open_, slots = open_[go], (slots[go] + 1) & (1 << self.bits) - 1
        return out


def slices(texts, chars: int = SLICE_CHARS):
    """Runs of texts of about so many characters; a longer text stands alone."""
    run, size = [], 0
    for text in texts:
        text = text.as_py() if isinstance(text, pa.Scalar) else text
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBPE:
    """One per worker process."""
    return ByteBPE(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 decoded: str | None = None) -> DataFrame:
    """The kept columns and ``ids``, the token ids of a text column as ``array<int>``.

    A null text has no ids, as the empty text. Control strings of the vocabulary inside a text become their
    own ids, as in the public library's default. With ``decoded`` the ids are also decoded again, into a
    column of that name. Texts cross to Python once, in slices that bound a worker's memory.
    """
    given = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("TEXT"))
    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType()))
    if decoded:
        schema = schema.add(decoded, StringType())

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts, at = batch.column(len(keep)), 0
            for some in slices(texts):
                ids = bpe.encode_many(some)
                columns = [c.slice(at, len(some)) for c in batch.columns[:-1]]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                if decoded:
                    columns.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()))
                at += len(some)
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        bpe.known.clear()  # Spark keeps the worker for other steps

    return given.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an id column; bytes that are no UTF-8 become the replacement character.

    Null ids give the empty text. An id the vocabulary does not hold is an error.
    """

    @F.pandas_udf("string")
    def decoded(lists):
        import pandas as pd

        bpe = vocabulary(path)
        return pd.Series(["" if x is None else bpe.decode(x.tolist()) for x in lists])

    return df.withColumn(text, decoded(F.col(ids)))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


__all__ = ["ByteBPE", "decode_ids", "encode_texts", "ids_text", "vocabulary"]
