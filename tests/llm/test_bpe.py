"""Encoding against the public library and decoding back."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from galley.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", " ", "  ", "\n", "\t", "\xa0", "'s", "1", "é", "<|endoftext|>", "!", "xxxxx", "\r\n", "'", "你", "\x1c",
          "\x85", "word", "the", "ing", "　", "é", "😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(library):
    mine, deal = bpe.ByteBPE(PATH), random.Random(5)
    texts = ["".join(deal.choice(PIECES) for _ in range(deal.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(texts, mine.encode_many(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert mine.decode(ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_long_words_take_the_same_merges(library):
    mine = bpe.ByteBPE(PATH)
    for word in ("thequickbrown" * 30, "a" * 500, "zq" * 250, "éà" * 100):
        data = word.encode()
        assert mine._short(data) == mine._long(data)
        assert mine.merge_many([data, b"the"])[0] == b"".join(i.to_bytes(4, "little") for i in mine._short(data)[1])
    word = "abcde" * 4000
    assert mine.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


def test_full_cache_keeps_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    mine = bpe.ByteBPE(PATH)
    for text in ("one two three four, five. one two", "six seven one two\neight"):
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library, tmp_path):
    rows = [(1, "Hello  world\n\nagain <|endoftext|> ok", None, "x"), (None, None, "en", None), (2, "", None, None),
            (2, "", None, None), (3, "long " * 30000, None, "y")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING, decoded STRING").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op8_bpe_round_trip"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table_and_kept_columns(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING, ids INT")
    assert bpe.encode_texts(docs, PATH).count() == 0
    rows = spark.createDataFrame([(1, "one two", "x"), (2, None, None)], "doc_id BIGINT, text STRING, lang STRING")
    got = bpe.decode_ids(bpe.encode_texts(rows, PATH, keep=("lang", "doc_id")), PATH)
    assert got.columns == ["lang", "doc_id", "ids", "decoded"]
    assert sorted(r.decoded for r in got.collect()) == ["", "one two"]


def test_workers_forget_chunks(spark):
    texts = spark.range(4000).repartition(8).selectExpr("id AS doc_id", "concat('some ', id, ' words ', id + 1) AS text")
    assert bpe.encode_texts(texts, PATH).count() == 4000
    path = PATH

    def held(batches):
        from galley.llm import bpe

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.vocabulary(path).known)] * len(batch))], ["held"])

    assert spark.range(16).repartition(8).mapInArrow(held, "held BIGINT").filter("held > 0").count() == 0
