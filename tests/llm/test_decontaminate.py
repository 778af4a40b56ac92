"""Leaks against a search of every window."""

import random

import numpy as np

from galley.llm import decontaminate as D
from galley.llm import queries


def slow_leaks(docs, items):
    out = []
    for key, text in docs:
        words = D.words_of(text or "")
        for item_id, item in items:
            target = D.words_of(item or "")
            size = min(len(target), len(words))
            if not size:
                continue
            counts = D.shingle_counts(target, 0, len(target))
            own = D.window_prints(target, np.zeros(1, np.int64), len(target))[0]
            windows, kept = [], []
            for start in range(len(words) - size + 1):
                if min(D.SHINGLE, size) < min(D.SHINGLE, len(target)):
                    continue
                score = D.similarity(D.shingle_counts(words, start, size), counts)
                bits = int(D.window_prints(words, np.array([start]), size)[0] ^ own).bit_count()
                if score >= D.SIMILARITY and bits <= D.RADIUS:
                    windows.append((-score, start))
            for score, start in sorted(windows):
                if all(abs(start - s) >= size for s in kept):
                    kept.append(start)
                    out.append((key, item_id, " ".join(words[start:start + size]), round(-score, 9)))
    return sorted(out, key=str)


def fixture():
    deal = random.Random(9)
    words = ["".join(deal.choices("abcdefgé", k=5)) for _ in range(150)]
    items = [(i, " ".join(deal.choices(words, k=deal.choice([14, 20, 33, 33, 59])))) for i in range(25)]
    items += [(100, "only three words"), (101, ""), (102, None), (103, items[0][1]), (None, " ".join(words[:30])), (104, "echo " * 12)]
    docs = []
    for i in range(60):
        filler = deal.choices(words, k=deal.randint(0, 80))
        passage = (deal.choice(items[:25])[1]).split()
        kind = i % 6
        if kind == 1:
            passage[deal.randrange(len(passage))] = "edited"
        elif kind == 2:
            passage = passage[2:]
        elif kind == 3:
            passage = [w.upper() for w in passage] * 2
        elif kind == 4:
            passage = []
        at = deal.randint(0, len(filler))
        docs.append((i, deal.choice([" ", "\n", " \t "]).join(filler[:at] + passage + filler[at:])))
    docs += [(200, None), (201, ""), (202, "has only three words inside"), (None, items[3][1]), (203, items[4][1]), (203, items[4][1]),
             (204, "echo " * 400), (205, " ".join(items[5][1].split()[:-1])), (206, "word " * 900 + items[6][1])]
    again = items[7][1].split()
    docs += [(207, " ".join([*again, "between", *again[:-1], "edited", "and", *again])), (208, " ".join(again * 3))]
    return docs, items


def test_query_matches_every_window(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id BIGINT, text STRING, item_id STRING, start INT").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*i, 2) for i in items], "item_id BIGINT, text STRING, doc_id INT").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES["op9_benchmark_decontamination"](spark, str(tmp_path)).collect()
    texts = {k: t for k, t in docs}
    found = sorted(((r.doc_id, r.item_id, " ".join(D.words_of(texts[r.doc_id][r.start:r.end])), round(r.similarity, 9)) for r in got), key=str)
    assert found == slow_leaks(docs, items)
    assert {r.doc_id for r in got} >= {0, 3, 5, 6, 202, 203, 206, None}
    assert sorted(r.similarity == 1 for r in got if r.doc_id == 207 and r.item_id == 7) == [False, True, True]
    assert sum(r.doc_id == 204 for r in got) == 400 // 12 and sum(r.doc_id == 208 and r.item_id == 7 for r in got) == 3


def test_items_in_several_passes_and_flags(spark, monkeypatch):
    docs, items = fixture()
    frame, bench = spark.createDataFrame(docs[:40], "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    once = sorted(map(str, D.leaks(frame, bench).collect()))
    monkeypatch.setattr(D, "ITEM_ROWS", 16)
    assert sorted(map(str, D.leaks(frame, bench).collect())) == once
    flagged = {r.doc_id for r in frame.filter(D.is_leaked(frame["text"], bench)).collect()}
    assert flagged == {r.doc_id for r in D.leaks(frame, bench).collect()}
    assert D.leaks(frame, bench.limit(0)).count() == 0 and D.leaks(frame.limit(0), bench).count() == 0


def test_blocks_find_all_within_radius():
    deal = np.random.default_rng(1)
    items = deal.integers(0, 2**63, 40, dtype=np.uint64)
    windows = np.array([int(deal.choice(items)) ^ sum(1 << int(b) for b in deal.choice(64, deal.integers(0, 24), replace=False)) for _ in range(300)], np.uint64)
    for radius in (3, 16):
        window, item = D.BlockIndex(items, radius).within(windows)
        want = {(w, i) for w in range(300) for i in range(40) if int(windows[w] ^ items[i]).bit_count() <= radius}
        assert {*zip(window.tolist(), item.tolist())} == want
