"""Ranked search by signatures against scoring every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from galley.llm import bloom_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(key, Counter(cut(text))) for key, text in docs]
    N, L = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(cut(text))
        scores = []
        for key, c in held:
            m = 75 + 25 * sum(c.values()) * N // max(L, 1)
            score = sum(times * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in asked.items() if t in c)
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=3):
    deal = random.Random(seed)
    words = ["".join(deal.choices("abcdeé", k=deal.randint(1, 5))) for _ in range(400)] + ["X9", "日本", "ÄB", "ab"]
    docs = [(i, deal.choice([" ", ", ", "\n"]).join(deal.choices(words[: deal.choice([40, 400])], k=deal.choice([1, 8, 60, 200])))) for i in range(260)]
    docs += [(500 + i, docs[i % 3][1]) for i in range(50)] + [docs[7], docs[7], (7, "ab"), (None, docs[9][1]), (None, None)]
    docs += [(800, ""), (801, None), (802, "?!"), (803, "ab " * 30_000 + " ".join(words)), (804, "日本日本 日本")]
    items = [(i, " ".join(deal.choices(words, k=deal.randint(1, 30)))) for i in range(25)]
    items += [(90, docs[40][1]), (91, ""), (92, None), (93, "nowhere-found"), (94, "AB ab aB ÄB"), (90, "ab"), (95, "日本")]
    return docs, items


def test_matches_brute_force_and_sql(spark, tmp_path):
    docs, items = corpus()
    clash = {c: F.lit(1) for c in ("name", "ROW", "id", "n", "t", "bits", "shard")}
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING").withColumns(clash).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id BIGINT, text STRING").withColumns(clash).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES["op12_bloom_ranked_search"](spark, str(tmp_path))
    want = brute(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(queries.ORACLES["op12_bloom_ranked_search"]).fetchall(), key=str) == want


def test_blocks_and_shards(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(bloom_search, "BLOCK_TERMS", 60)
    monkeypatch.setattr(bloom_search, "SHARD_ROWS", 64)
    got = bloom_search.search(spark.createDataFrame(items, "item_id BIGINT, text STRING"), spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), k=5)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = corpus()
    no_docs, no_items = spark.createDataFrame([], "doc_id BIGINT, text STRING"), spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert bloom_search.search(no_items, spark.createDataFrame(docs, no_docs.schema)).collect() == []
    assert bloom_search.search(spark.createDataFrame(items, no_items.schema), no_docs).collect() == []


def test_bounds_hold():
    docs, items = corpus(5)
    counts = [Counter(cut(t)) for _, t in docs if cut(t)]
    N, L = len(counts), sum(sum(c.values()) for c in counts)
    asked = [(i, {t: 3 for t in cut(text)}) for i, (_, text) in enumerate(items) if cut(text)]
    block = bloom_search.Block(asked)
    bits = 4096
    one = np.zeros((N, bits), bool)
    for row, c in zip(one, counts):
        row[bloom_search.places(bloom_search.facts_of(c), bits)] = True
    n = np.array([sum(c.values()) for c in counts])
    for (_, weights), bound in zip(asked, bloom_search.shard_bounds(block, n, np.packbits(one, axis=1, bitorder="little"), N, L)):
        for c, size, b in zip(counts, n.tolist(), bound.tolist()):
            m = 75 + 25 * size * N // L
            assert b >= sum(w * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, w in weights.items() if t in c)
