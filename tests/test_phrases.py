"""Phrases from word vectors, against the window form and in the job."""

import random

from pyspark.sql import functions as F

from galley.checks.jobs import site_rules
from galley.operators.keyphrases import keyphrases_mmr
from galley.operators.phrases import phrase_scores, word_vectors
from galley.plans.run import run
from galley.schemas import ARTICLES, PAGES


def test_matches_the_window_form(spark):
    deal = random.Random(2)
    vecs = {w: [deal.uniform(-1, 1) for _ in range(4)] for w in "abcdefgh"}
    texts = {i: deal.choices("abcdefgh", k=deal.randint(1, 12)) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id INT, terms ARRAY<STRING>")
    vectors = spark.createDataFrame(list(vecs.items()), "term STRING, vec ARRAY<DOUBLE>")
    got = {(r.doc_id, r["rank"]): (r.term, round(r.score, 6)) for r in phrase_scores(docs, vectors, "terms", longest=3).collect()}
    mean = lambda ws: [sum(vecs[w][d] for w in ws) / len(ws) for d in range(4)]
    grams = {(i, " ".join(t[a:a + n])): t[a:a + n] for i, t in texts.items() for n in (1, 2, 3) for a in range(len(t) - n + 1)}
    cands = spark.createDataFrame([(i, p, mean(ws)) for (i, p), ws in grams.items()], "doc_id INT, term STRING, vec ARRAY<DOUBLE>")
    whole = spark.createDataFrame([(i, mean(t)) for i, t in texts.items()], "doc_id INT, vec ARRAY<DOUBLE>")
    want = {(r.doc_id, r["rank"]): (r.term, round(r.score, 6)) for r in keyphrases_mmr(cands, whole, 5, 0.5).collect()}
    assert got == want


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, []), (3, ["x"]), (4, ["a", None, "a"]), (None, ["a", "x"])], "doc_id INT, terms ARRAY<STRING>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [2.0, 0.0]), (None, [1.0, 1.0]), ("b", None)], "term STRING, vec ARRAY<DOUBLE>")
    got = {r.doc_id for r in phrase_scores(docs, vectors, "terms").collect()}
    assert got == {4, None}
    assert word_vectors(docs.limit(2), "terms").count() == 0


def test_more_words_than_one_task_would_hold(spark):
    docs = spark.range(101_000).selectExpr("id DIV 1000 AS doc_id", "'w' || id AS term").groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    vectors = spark.range(101_000).selectExpr("'w' || id AS term", "array(double(id % 7), 1.0D) AS vec")
    few = phrase_scores(docs, vectors, "terms", k=1, longest=1)
    assert few.count() == 101
    one = phrase_scores(docs.filter("doc_id = 5"), vectors, "terms", k=1, longest=1).collect()
    assert [tuple(r) for r in few.filter("doc_id = 5").collect()] == [tuple(r) for r in one]


def test_vocabulary_is_bounded(spark):
    docs = spark.createDataFrame([(1, ["a"] * 9 + ["b"] * 5 + ["c"] * 3 + ["d"])], "doc_id INT, terms ARRAY<STRING>")
    assert {r.term for r in word_vectors(docs, "terms", 4, words=2).collect()} == {"a", "b"}
    assert {r.term for r in word_vectors(docs, "terms", 4).collect()} == {"a", "b", "c"}


def test_job_ranks_latin_articles_by_phrases(spark):
    body = "solar panels power the small village and solar panels power the old school near the village road. "
    page = lambda text: f"<html><body><h1>T</h1><article><p>{text}</p></article></body></html>"
    nav = "<html><body><nav><ul><li><a href='/a'>a</a></li><li><a href='/b'>b</a></li></ul></nav></body></html>"
    pages = spark.createDataFrame([(1, "http://t.test/1", nav), (2, "http://t.test/a", page(body * 3)), (3, "http://t.test/b", page("中文很好很好"))], PAGES)
    starts = spark.createDataFrame([("t.test", "http://t.test/1")], "site STRING, start STRING")
    rules = site_rules(spark, "", extract=True, sites=starts)
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = run(spark, rules, pages, spark.createDataFrame([], ARTICLES), as_of, phrase_vectors=True).articles.select("url", "tags").collect()
    tags = {r.url: r.tags for r in rows}
    assert any(" " in t for t in tags["http://t.test/a"]) and tags["http://t.test/b"]
