"""Held-out accuracy, and the cases in which there is nothing to learn."""

import random

import numpy as np

from galley.llm import cotraining as C
from galley.llm import queries

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING"
LABELS = "doc_id BIGINT, quality INT, toxic INT, text STRING"


def fixture(n=600):
    deal = random.Random(3)
    words = ["".join(deal.choices("abcdefghij", k=deal.randint(2, 9))) for _ in range(400)]
    docs, good = [], {}
    for i in range(n):
        good[i] = int(deal.random() < 0.7)
        some = deal.choices(words, k=deal.randint(20, 200))
        text = " ".join(some) if good[i] else deal.choice([" | ".join(some), "!! ".join(w.upper() for w in some), (some[0] + " ") * 90])
        source = f"src{deal.randrange(3)}" if good[i] else f"src{deal.randrange(2, 6)}"
        docs.append((i, text, deal.choice(["en", "fr", None]), source, len(text), "x"))
    return docs, good


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")


def test_query_on_held_out_documents(spark, tmp_path):
    docs, good = fixture()
    odd = [(None, None, None, None, None, None), (9000, "", None, None, None, ""), (9001, "long " * 50000, "en", "src1", -5, ""), (5, docs[5][1], *docs[5][2:])]
    labels = [(i, good[i], 0, "") for i in range(0, 600, 4)] + [(None, 1, 0, ""), (3, None, 0, ""), (4, good[4], 0, ""), (99999, 0, 0, "")]
    write(spark, tmp_path, docs + odd, labels)
    got = queries.QUERIES["op10_cotraining_quality"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))
    rest = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 4]
    assert np.mean([r.keep == good[r.doc_id] for r in rest]) > 0.97
    views = [np.mean([(getattr(r, v) >= 0.5) == good[r.doc_id] for r in rest]) for v in ("meta_score", "score")]
    assert views[1] >= views[0]
    assert abs(np.mean([r.score for r in rest]) - np.mean([good[r.doc_id] for r in rest])) < 0.08  # calibrated


def test_nothing_to_learn(spark, tmp_path):
    docs, _ = fixture(30)
    for name, labels, share in (("none", [], 1.0), ("one", [(i, 1, 0, "") for i in range(20)], 1.0), ("few", [(1, 0, 0, ""), (2, 1, 0, "")], 0.5)):
        write(spark, f"{tmp_path}/{name}", docs, labels)
        got = queries.QUERIES["op10_cotraining_quality"](spark, f"{tmp_path}/{name}").collect()
        assert {(r.score, r.keep) for r in got} == {(share, True)}
    write(spark, f"{tmp_path}/empty", [], [])
    assert queries.QUERIES["op10_cotraining_quality"](spark, f"{tmp_path}/empty").count() == 0


def test_views_teach_one_another():
    deal = np.random.default_rng(5)
    y = deal.integers(0, 2, 3000).astype(float)
    text = np.c_[y + deal.normal(0, 0.6, 3000), deal.normal(0, 1, (3000, 3))]
    meta = np.c_[y + deal.normal(0, 0.6, 3000), deal.normal(0, 1, (3000, 30))]
    held = np.arange(60) % 4 == 0

    def accuracy(rounds):
        model = C.co_train(text[:60], meta[:60], y[:60], held, text[60:2000], meta[60:2000], rounds)
        return np.mean((model.meta.logit(meta[2000:]) > 0) == y[2000:])

    assert accuracy(5) > accuracy(0)
