"""Simple-8b round trips and token files against the public library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from galley.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["The", "ing", " ", "\n", ".", ",", "'s", "12", "É", "é", "İ", "क़", "<|endoftext|>", "😀", "\t", "\xa0", "\x1c", "!"]


@pytest.mark.parametrize("seed", range(8))
def test_code_round_trip(seed):
    deal = np.random.default_rng(seed)
    parts = [deal.integers(0, 1 << int(w), int(deal.integers(1, 300)), dtype=np.uint64) for w in deal.integers(0, 64, 12)]
    values = np.concatenate([*parts, np.zeros(500, np.uint64), np.array([2**64 - 1, 0, 2**60, 2**60 - 1], np.uint64)])
    words, raw = token_files.pack(values)
    assert (token_files.unpack(words, raw, len(values)) == values).all()
    ends, back = token_files.read_block(token_files.write_block([3, 0, len(values) - 3], values))
    assert ends.tolist() == [3, 3, len(values)] and (back == values).all()


def test_code_is_greedy_and_small():
    assert len(token_files.pack(np.zeros(240, np.uint64))[0]) == 2
    assert len(token_files.pack(np.ones(60, np.uint64))[0]) == 1
    assert len(token_files.pack(np.full(9, 49407, np.uint64))[0]) == 3
    assert [len(x) for x in token_files.pack(np.empty(0, np.uint64))] == [0, 0]


def test_chunks_give_the_library_s_ids(monkeypatch):
    library, mine, deal = Tokenizer.from_file(PATH), token_files.ChunkedTokenizer(PATH), random.Random(1)
    texts = ["".join(deal.choice(PIECES) for _ in range(deal.randint(0, 12))) for _ in range(3000)]
    for full in (10**6, 5):
        monkeypatch.setattr(token_files, "CACHED_CHUNKS", full)
        for text, ids in zip(texts, mine.encode_many(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        texts = texts[:50]


def test_few_chunks_are_asked_for():
    library, mine = Tokenizer.from_file(PATH), token_files.ChunkedTokenizer(PATH)
    texts = [f'("Word{i}",\n\'Été{i}!\' it\'s 3x{i}/{i})' for i in range(2000)]
    for text, ids in zip(texts, mine.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(mine.known) < 40  # words, digits and marks, not each number beside each of them


def test_cuts_beside_quotes_controls_and_other_letters(monkeypatch):
    library, deal = Tokenizer.from_file(PATH), random.Random(2)
    pieces = [*PIECES, "'", "'S", "'RE", "\"'t", "<|ENDOFTEXT|>", "<|endof", "text|>", "|", "×", "ß", "½", "ª", "’s", "e\u0301",
              "=\u0338", "\u0338", "Œ", "\x85", "\r\n", "aB3", "word" * 90]
    for full in (token_files.CACHED_BYTES, 50):
        monkeypatch.setattr(token_files, "CACHED_BYTES", full)
        mine = token_files.ChunkedTokenizer(PATH)
        for _ in range(20):
            texts = ["".join(deal.choice(pieces) for _ in range(deal.randint(0, 12))) for _ in range(100)]
            for text, ids in zip(texts, mine.encode_many(texts)):
                assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_query(spark, tmp_path):
    rows = [(9, "Hello, world.\nAgain!", 1), (None, "first", None), (2, None, 2), (4, "", 3), (4, "", 3), (4, "same key", 3),
            (7, "long " * 140000, 4)] + [(100 + i, "a hot key", 1) for i in range(50)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, start INT").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op5_simple8b_token_files"](spark, str(tmp_path)).collect()), key=lambda r: r[1])
    library, start, want = Tokenizer.from_file(PATH), 0, []
    rows = [(k, t) for k, t, _ in rows]
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    assert [r[0] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    left = sorted((k if k is not None else -1, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for k, t in rows)
    assert left == sorted((k if k is not None else -1, n, c) for k, _, n, c in got)
    for _, at, n, _ in got:
        assert at == start
        start += n


def test_empty_table_and_small_blocks(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert token_files.token_files(empty, PATH).count() == 0
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], empty.schema)
    token_files.write_token_files(docs, str(tmp_path / "t"), PATH, block_ids=7)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [r.start for r in got] == [sum(j + 1 for j in range(i)) for i in range(40)]
    assert all(r.ids[-1] == 2 and len(r.ids) == r.doc_id + 1 for r in got)
