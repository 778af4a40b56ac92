"""Top-k inner products against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galley.llm import maxscore, queries


def slow(rows, k=20, every=20):
    vectors = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        vectors[vec_id] = min(vectors.get(vec_id, q), q)
    out = []
    for a in vectors:
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(vectors[a], vectors[b])), b) for b in vectors if b != a)[:k]
            out += [(a, i, b, -s) for i, (s, b) in enumerate(scored, 1)]
    return sorted(out)


def fixture(n=900):
    deal = np.random.default_rng(3)
    rows = [(i, deal.normal(0, 0.3, 12).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(200)]  # one very common vector
    rows += [(2000, [0.0] * 12), (2020, [1.0] * 5), (2040, []), (2060, None), (2080, [None] + [1.0] * 11), (2100, [math.nan] * 12),
             (2120, [math.inf] + [0.0] * 11), (None, [1.0] * 12), (5, rows[5][1]), (2140, [-3.0] * 12), (2141, [9.0] * 12)]
    return rows


def test_query(spark, tmp_path):
    frame = spark.createDataFrame([(i, v, 3, 1) for i, v in fixture()], "vec_id BIGINT, embedding ARRAY<FLOAT>, score INT, shard INT")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op2_maxscore_top_k"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == slow(fixture())


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 7)
    rows = fixture(150)
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = maxscore.top_k(frame, F.col("id") % 20 == 0, 5, shard_rows=9)
    assert sorted(map(tuple, got.collect())) == slow(rows, 5)


@pytest.mark.parametrize("seed", range(6))
def test_pruned_search_is_exact(seed, monkeypatch):
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 8)
    deal = np.random.default_rng(seed)
    rows = deal.integers(-3, 4, (200, 6)) * (deal.random((200, 6)) < 0.4)
    rows = rows * deal.integers(1, 30, (200, 1)) if seed % 2 else rows
    ids = deal.permutation(200)
    postings = maxscore.Postings(ids, rows)
    for query in [*deal.integers(-4, 5, (20, 6)), np.zeros(6, np.int64)]:
        got = postings.search(-1, query, 7)
        want = sorted(zip((-(rows @ query)).tolist(), ids.tolist()))[:7]
        assert [(-s, i) for i, s in zip(*map(np.ndarray.tolist, got))] == want


def test_empty_table(spark):
    assert maxscore.top_k(spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>"), F.col("id") % 20 == 0).count() == 0


def test_queries_searched_together_find_the_same_rows():
    import numpy as np

    from galley.llm.maxscore import Postings

    draw = np.random.default_rng(5)
    rows = draw.integers(-3, 4, (3_000, 6)).astype(float)  # small numbers: many equal scores
    rows[2_000:] *= 0.0  # blocks that no query needs, where its best scores are above zero
    ids = draw.permutation(3_000)
    postings = Postings(ids, rows)
    for k in (1, 20):
        place, found, scores = postings.search_many(ids[:70], rows[:70], k)
        for i in range(70):
            want_ids, want = postings.search(ids[i], rows[i], k)
            exact = sorted((-float(rows[i] @ rows[j]), int(ids[j])) for j in range(3_000) if j != i)[:k]
            assert [(-s, n) for s, n in zip(scores[place == i], found[place == i])] == exact == [(-s, n) for s, n in zip(want, want_ids)]
    none = postings.search_many(ids[:0], rows[:0], 3)
    assert all(len(c) == 0 for c in none)
