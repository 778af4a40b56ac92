"""Token-id files in Simple-8b blocks.

Documents are dealt by ranges of the key, tokenised where they land and packed into blocks of whole
documents. A block's ids are Simple-8b words: the top four bits of a 64-bit word select how many ids of
which width share its other sixty. Selector 0 is the escape: its word holds the place of a value of more
than sixty bits in the list of raw values that ends the block, so every word can be decoded on its own. A
block also holds the offset of each document's end, so a document is cut out without decoding others by hand.

File format: a folder of Parquet files, a row per block in ascending order of ``(part, block)``, with the
keys of its documents and the block's bytes: four unsigned 32-bit counts (documents, ids, words, raw
values), the documents' end offsets as unsigned 32-bit numbers, then words and raw values as unsigned
64-bit numbers, all little-endian.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from galley.llm.common import shared_path

#: (ids, bits) of selectors 2 to 15; fixed values of the published code. Selector 1 is a run of 120 zeros.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
            (2, 30), (1, 60)]
ZEROS = 120
COUNTS = np.array([1, ZEROS] + [c for c, _ in PACKINGS])
WIDTHS = {count: (selector, width) for selector, (count, width) in enumerate(PACKINGS, 2) if count > 1} | {ZEROS: (1, 0)}
#: How windows of a size are put together from two smaller ones.
WINDOWS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 7),
           20: (10, 10), 30: (15, 15), 60: (30, 30), 120: (60, 60)}
BLOCK_IDS = 1 << 17
#: Chunks and bytes of them that a worker remembers, bytes of text taken at a time, words in a text put to the library.
CACHED_CHUNKS, CACHED_BYTES, SLICE_BYTES, ASKED = 200_000, 16_000_000, 1_000_000, 50_000
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Kinds of bytes. Letters are ASCII ones and those of U+00C0 to U+00FF; a quote may belong to the letters behind it.
BLANK, LETTER, DIGIT, MARK, QUOTE, OTHER = range(6)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[:128] = MARK
KINDS[[*b" \n"]] = BLANK
KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 0xC3, *range(0x80, 0xC0)]] = LETTER
KINDS[[*b"0123456789"]] = DIGIT
KINDS[ord("'")] = QUOTE
KINDS[[0x97, 0xB7]] = OTHER  # behind 0xC3, the signs of multiplication and division
#: Whether ``PATTERN`` always begins anew between two kinds, at ``6 * kind + next kind``.
CUTS = np.array([b != BLANK and (a == BLANK or DIGIT in (a, b) or (a == LETTER) != (b == LETTER) and (a, b) != (QUOTE, LETTER))
                 for a in range(OTHER + 1) for b in range(OTHER + 1)])
BLANK_CUTS = np.array([b != BLANK and a == BLANK for a in range(OTHER + 1) for b in range(OTHER + 1)])
#: Lower case of the bytes of such letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[[*range(0x41, 0x5B), *range(0x80, 0x97), *range(0x98, 0x9F)]] += 0x20
BLOCKS = "part INT, block INT, before BIGINT, n_ids BIGINT, keys ARRAY<BIGINT>, data BINARY"
TOKENS = "KEY BIGINT, start BIGINT, ids ARRAY<INT>"


# the code -------------------------------------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and raw values of unsigned 64-bit numbers. Each word takes the most values that fit."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    top = int(values.max())
    padded = np.r_[values, np.zeros(ZEROS, np.uint64)]  # what is beyond the end counts as zero
    chosen = np.full(n, 15, np.int8)
    # the largest of the next ``count`` values, for growing counts; once a count fits nowhere, no larger one does
    narrow = padded.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    largest = {1: narrow}
    for count, (a, b) in WINDOWS.items():
        largest[count] = np.maximum(largest[a][:len(padded) - count + 1], largest[b][a:a + len(padded) - count + 1])
        if count not in WIDTHS:
            continue
        selector, width = WIDTHS[count]
        fits = largest[count][:n] <= min((1 << width) - 1, int(np.iinfo(narrow.dtype).max))
        if not fits.any():
            break
        chosen[fits] = selector
    if top >> 60:
        chosen[values >> np.uint64(60) != 0] = 0
    # the place of the word after the next 1, 2, 4, ... words; the longest steps are walked, then the words between put in
    steps = [np.r_[np.minimum(np.arange(n) + COUNTS[chosen], n), n]]
    for _ in range(6):
        steps.append(steps[-1][steps[-1]])
    heads, i, far = [], 0, steps.pop()
    while i < n:
        heads.append(i)
        i = int(far[i])
    heads = np.array(heads)
    for step in reversed(steps):
        heads = np.column_stack([heads, step[heads]]).ravel()
    heads = heads[heads < n]
    selectors = chosen[heads]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector, (count, width) in enumerate(PACKINGS, 2):
        at = np.flatnonzero(selectors == selector)
        if len(at):
            first, word = heads[at], words[at]
            for k in range(count):
                word |= padded[first + k] << np.uint64(k * width)
            words[at] = word
    escaped = np.flatnonzero(selectors == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, values[heads[escaped]]


def unpack(words: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values, each selector's words decoded together."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector, (count, width) in enumerate(PACKINGS, 2):
        at = np.flatnonzero(selectors == selector)
        if len(at):
            word, first, mask = words[at], begins[at], np.uint64((1 << width) - 1)
            for k in range(count):
                out[first + k] = word >> np.uint64(k * width) & mask
    escaped = np.flatnonzero(selectors == 0)
    if len(escaped):
        out[begins[escaped]] = raw[(words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def write_block(sizes: list[int], ids: np.ndarray) -> bytes:
    words, raw = pack(ids)
    counts = np.array([len(sizes), len(ids), len(words), len(raw)], "<u4")
    return b"".join([counts.tobytes(), np.cumsum(sizes).astype("<u4").tobytes(), words.astype("<u8").tobytes(),
                     raw.astype("<u8").tobytes()])


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """End offsets of the block's documents, and all its ids."""
    docs, n, n_words, n_raw = np.frombuffer(data, "<u4", 4).tolist()
    ends = np.frombuffer(data, "<u4", docs, 16).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, 16 + 4 * docs)
    raw = np.frombuffer(data, "<u8", n_raw, 16 + 4 * docs + 8 * n_words)
    return ends, unpack(words, raw, n)


# the tokenizer --------------------------------------------------------------------------------------

def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array's texts end to end, and the places where texts begin and the last one ends."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    bounds = np.frombuffer(places, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of so many items from each beginning, run after run."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class ChunkedTokenizer:
    """The public library, asked once for each chunk of text.

    For vocabularies whose pattern drops white space, so that no token reaches over a blank or line end; a control
    string with white space inside would, and makes the whole text go to the library. Where the pattern is
    ``PATTERN``, chunks of ASCII and Latin letters are also cut between letters, digits and marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(self.library.to_str())
        self.case = LOWER if "Lowercase" in json.dumps(parts.get("normalizer")) else np.arange(256, dtype=np.uint8)
        self.cuts = CUTS if json.dumps(PATTERN) in json.dumps(parts.get("pre_tokenizer")) else BLANK_CUTS
        control = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.whole = any(c.isspace() for t in control for c in t)
        self.control = {self.case[[*t.encode()]].tobytes() for t in control}
        suffix = parts["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a run of letters
        if suffix and self.cuts is CUTS:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._keep(pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64))

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        found = [np.array(f.ids, "<u4") for f in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, "<u4"), *found]), np.array([len(ids) for ids in found], np.int64)

    def _ask_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ask``; runs of letters many to a text, where the last token of each is known by its suffix."""
        data, bounds = text_bytes(chunks)
        others = np.r_[0, np.cumsum(KINDS[data] != LETTER)][bounds]
        runs = (np.diff(others) == 0) & self.last.any()
        texts = chunks.to_numpy(zero_copy_only=False)
        words = texts[runs]
        ids, _ = self._ask([" ".join(words[i:i + ASKED]) for i in range(0, len(words), ASKED)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1:].sum() != len(ids):
            return self._ask(texts.tolist())
        rest, rest_sizes = self._ask(texts[~runs].tolist())
        sizes, begins = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        sizes[runs], sizes[~runs] = np.diff(ends, prepend=0), rest_sizes
        begins[runs], begins[~runs] = ends - sizes[runs], len(ids) + np.cumsum(rest_sizes) - rest_sizes
        return np.r_[ids, rest][_places(begins, sizes)], sizes

    def _keep(self, chunks: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known, self.ids, self.sizes = chunks, ids, sizes

    def _ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ask``, of different chunks, kept for the next slices; a full cache keeps those of the last one alone."""
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(at.is_null())
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        if len(new):
            at[at < 0] = np.arange(len(self.known), len(self.known) + len(new))
            ids, sizes = self._ask_chunks(new)
            self._keep(pa.concat_arrays([self.known, new]), np.r_[self.ids, ids], np.r_[self.sizes, sizes])
        sizes = self.sizes[at]
        ids = self.ids[_places((np.cumsum(self.sizes) - self.sizes)[at], sizes)]
        if len(self.known) > CACHED_CHUNKS or self.known.nbytes > CACHED_BYTES:
            self._keep(chunks, ids, sizes)
        return ids, sizes

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of texts begin, and the bytes with Latin letters in the vocabulary's own case.

        Between blanks, what holds other characters than ASCII and Latin letters, or a control string in any case,
        stays one chunk as it is.
        """
        kind = KINDS[data]
        solid = kind != BLANK
        firsts = bounds[:-1][np.diff(bounds) > 0]
        small, begin = self.case[data], np.empty(len(data), bool)
        begin[1:] = self.cuts[kind[:-1] * np.uint8(OTHER + 1) + kind[1:]]
        begin[firsts] = solid[firsts]
        odd = [np.flatnonzero(kind == OTHER)]
        searched = small.tobytes()
        for control in self.control:
            places, at = [], searched.find(control)
            while at >= 0:
                places.append(at)
                at = searched.find(control, at + 1)
            odd.append(np.array(places, np.int64))
        odd = np.concatenate(odd)
        if len(odd):
            plain = solid.copy()
            plain[1:] &= ~solid[:-1]
            plain[firsts] = solid[firsts]
            at = np.flatnonzero(plain)
            whole = np.zeros(len(at), bool)
            whole[np.searchsorted(at, odd, "right") - 1] = True
            inside = np.r_[np.zeros(at[0], bool), np.repeat(whole, np.diff(np.r_[at, len(data)]))]
            begin, small = np.where(inside, plain, begin), np.where(inside, data, small)
        return begin, small

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where those of each text end.

        The chunks are numbered, the ids of different ones looked up, and those of all taken by number.
        """
        if self.whole:
            ids, sizes = self._ask([data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])])
            return ids, np.cumsum(sizes)
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        begin, small = self._cut(data, bounds)
        chunks_before = np.searchsorted(np.flatnonzero(begin), bounds[1:])
        solid = KINDS[data] != BLANK
        small, begins = small[solid], np.flatnonzero(begin[solid])
        ends = np.r_[begins, len(small)].astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(small)).dictionary_encode()
        ids, sizes = self._ids_of(chunks.dictionary)
        numbers = chunks.indices.to_numpy()
        counts = sizes[numbers]
        return ids[_places((np.cumsum(sizes) - sizes)[numbers], counts)], np.r_[0, np.cumsum(counts)][chunks_before]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        ids, ends = self.encode(*text_bytes(pa.array(texts, pa.large_string())))
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkedTokenizer:
    """One per worker process."""
    return ChunkedTokenizer(path)


# files ----------------------------------------------------------------------------------------------

def _slices(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text stands alone."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, to
        at = to


def _pack_documents(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        keys, sizes, held, n, before = [], [], [], 0, 0

        def flush():
            data = write_block(sizes, np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["part", "block", "before", "n_ids", "keys", "data"])

        for batch in batches:
            doc_keys = batch.column(0).to_pylist()
            data, bounds = text_bytes(batch.column(1))
            for at, to in _slices(bounds, SLICE_BYTES):
                ids, ends = tokenizer(path).encode(data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at])
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, to - at + 1)
                taken = done = 0
                for key, upto in zip(doc_keys[at:to], ends.tolist()):
                    keys.append(key)
                    sizes.append(upto - done)
                    n, done = n + upto - done, upto
                    if n >= block_ids:
                        held.append(ids[taken:upto])
                        yield flush()
                        block, before, n, taken = block + 1, before + n, 0, upto
                        keys, sizes, held = [], [], []
                held.append(ids[taken:])
        if keys:
            yield flush()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 2, key: str = "doc_id",
                      text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, each closed by ``end_id``, in ascending order of the key.

    A null text is empty, a null key comes first; rows with equal keys are ordered by their texts. The range
    of a key that many rows share is cut further by the texts' hashes. Blocks hold whole documents, so one
    longer than ``block_ids`` has a block of its own.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    dealt.mapInArrow(_pack_documents(tokenizer_path, end_id, block_ids), BLOCKS).write.parquet(out)


def _unpack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, keys, data in zip(*batch.columns):
            before, keys = before.as_py(), keys.as_py()
            ends, ids = read_block(data.as_py())
            begins = np.r_[0, ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(before + begins, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.uint32).view(np.int32)))],
                ["KEY", "start", "ids"])


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, ids)`` of every document: ``start`` counts all ids before it.

    A block knows the ids before it in its part. What the parts before hold is carried on over one row per
    part, as many as tasks wrote the files, whatever the number of documents; only those rows are sent around.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    carried = sums.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("carried"))
    placed = blocks.join(F.broadcast(carried), "part").select((F.col("carried") + F.col("before")).alias("before"), "keys", "data")
    return placed.mapInArrow(_unpack_documents, TOKENS).withColumnRenamed("KEY", key)


def crc32_of_ids(ids):
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("bigint")
    def crc(lists):
        import pandas as pd

        return pd.Series([zlib.crc32(np.asarray(x, "<i4").tobytes()) for x in lists], dtype="int64")

    return crc(ids)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Write to ``out``, or a new folder below the shared one, and read back."""
    out = out or shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, out, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, out)
