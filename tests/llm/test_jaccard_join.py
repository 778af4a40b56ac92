"""The similarity join by several orders against comparing all pairs."""

import random
import re
import tracemalloc
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from galley.llm import jaccard_join, queries

SCHEMA = "doc_id BIGINT, text STRING"


def brute_sets(rows, size=4):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return sets


def brute(rows, size=4, percent=85):
    sets = brute_sets(rows, size)
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in combinations([i for i, s in enumerate(sets) if s], 2):
        a, b = sets[i], sets[j]
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            least[root(j)] = root(i)
    keys = {}
    for i, (key, _) in enumerate(rows):
        keys.setdefault(root(i), []).append(key)
    named = {r: min((k for k in held if k is not None), default=None) for r, held in keys.items()}
    return sorted([(k, len(sets[i]), named[root(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)], key=str)


def corpus(seed):
    deal = random.Random(seed)
    words = ["".join(deal.choices("abcdefgh", k=deal.randint(2, 6))) for _ in range(300)]
    passage = deal.choices(words, k=60)
    rows = []
    for i in range(120):
        text = deal.choices(words, k=deal.choice([1, 2, 3, 4, 5, 30, 90, 160]))
        if i % 3 == 0:
            text[5:5] = passage
        rows.append(text)
    for start in (0, 3, 7, 11):
        base = deal.choices(words, k=70)
        for _ in range(60):
            copy = list(base)
            for _ in range(deal.randint(0, 4)):
                copy[deal.randrange(len(copy))] = deal.choice(words)
            rows.append(copy)
    rows = [(i, deal.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(rows)]
    rows += [(1000, rows[5][1].upper()), (1001, ""), (1002, None), (1003, " \t"), (1004, ""), (None, rows[130][1]), (None, "only here"),
             rows[140], rows[140], (140, "same key other text"), (1005, "é É ü Ü"), (1006, "é É ü ü"), (1007, " ".join(words * 60))]
    return rows + [(1008, " ".join(words * 60) + " end")]


def test_matches_all_pairs_and_sql(spark, tmp_path):
    for seed in (1,):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("NODE", "n", "key", "t", "row1", "root")})
        docs.repartition(3).write.parquet(str(tmp_path / f"{seed}/documents.parquet"))
        got = queries.QUERIES["op11_ngram_jaccard_join"](spark, str(tmp_path / str(seed)))
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        want = brute(rows)
        assert sorted([tuple(r) for r in got.collect()], key=str) == want
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{seed}/documents.parquet/*.parquet'")
        assert sorted(con.execute(queries.ORACLES["op11_ngram_jaccard_join"]).fetchall(), key=str) == want


def test_other_parameters(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    for size, percent, orders in ((5, 80, 2),):  # chunks smaller than the buckets
        got = jaccard_join.components(docs, size=size, percent=percent, orders=orders, chunk=7).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute(rows, size, percent)


def test_empty_table(spark):
    assert jaccard_join.components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_linked_nodes_meet_in_every_order(spark):
    """Sets of numbers: every pair that links shares a prefix shingle under each order."""
    deal = random.Random(4)
    sets = []
    for _ in range(60):
        base = deal.sample(range(2000), deal.randint(1, 40))
        sets += [sorted({x if deal.random() > 0.05 else deal.randrange(2000) for x in base}) for _ in range(3)]
    sets = [list(s) for s in {tuple(s) for s in sets}]
    rows = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "node BIGINT, n INT, set ARRAY<BIGINT>")
    met = {}
    for r in jaccard_join.met_in(rows, 3, 85).collect():
        met.setdefault((r.order, r.node), set()).add(r.h)
    linked = 0
    for i, j in combinations(range(len(sets)), 2):
        both = len({*sets[i]} & {*sets[j]})
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            linked += 1
            assert all(met.get((o, i), set()) & met.get((o, j), set()) for o in range(3))
    assert linked > 20


def test_parities_come_with_the_sets(spark):
    texts = ["a b c d e f", "one", "", None, " ".join(f"w{i % 400}" for i in range(3000))]
    got = jaccard_join.add_sets(spark.createDataFrame([(t,) for t in texts], "t STRING"), "t", 4, 3, parity=True).collect()
    for text, row in zip(texts, got):
        whole = jaccard_join.shingle_set(text, 4)
        assert row.n == len(whole) and row.bits == jaccard_join.parities(whole).tolist()


def test_words_remembered_are_bounded():
    words = jaccard_join.WORDS
    words.clear()
    jaccard_join.shingle_set(" ".join(f"w{i}" for i in range(300_010)))
    for i in range(30):
        jaccard_join.shingle_set(f"{i}" * 500_000)
    assert len(words) <= 300_000 and sum(map(len, words)) < 10_000_000
    words.clear()


def test_workers_forget_words(spark):
    texts = spark.range(4000).repartition(8).select(F.concat_ws(" ", F.lit("some"), "id", F.lit("words"), F.col("id") + 1).alias("t"))
    assert jaccard_join.add_sets(texts, "t", 4).count() == 4000

    def held(batches):
        from galley.llm import jaccard_join

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(jaccard_join.WORDS)] * len(batch))], ["held"])

    assert spark.range(16).repartition(8).mapInArrow(held, "held BIGINT").filter("held > 0").count() == 0


def test_a_large_cell_takes_little_memory():
    deal = np.random.default_rng(4)
    size, near = 4096, [(3, 4000), (90, 91), (700, 2900)]
    columns = {f: np.arange(size) for f in ("node", "root")} | {"n": np.full(size, 100, np.int32), "place": np.zeros(size, np.int32)}
    columns |= {f: deal.integers(-2 ** 63, 2 ** 63, size) for f in jaccard_join.FOLDED}
    for a, b in near:
        for f in jaccard_join.FOLDED:
            columns[f][b] = columns[f][a] ^ 1
    cell = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], [*columns])
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), cell)],
                                       ["order", "members"])
    tracemalloc.start()
    found = [p for out in jaccard_join._pair_cells(85, False)([batch]) for p in zip(*(c.to_pylist() for c in out.columns))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [(1, a, b, 4) for a, b in near]
    assert peak < 24_000_000
