"""Abbreviations learned from a corpus, and sentences that do not end at them."""

import math

from pyspark.sql import functions as F

from galley.checks.jobs import site_rules
from galley.functions import text as T
from galley.operators.abbreviations import abbreviation_scores, abbreviations, with_abbreviations
from galley.operators.scoring import sentences
from galley.plans.run import run
from galley.schemas import ARTICLES, PAGES

TALK = ["Yesterday Dr. %s came to the town by train.", "The people of the town liked Dr. %s and the train.",
        "A train to the U.S. would please the people.", "It was seen in the U.S. by people of the town.", "We like the town and the train."]
NAMES = ["Able", "Baker", "Cole", "Dunn", "Evans", "Frost", "Gray", "Hart"]


def talk(spark):
    texts = [" ".join(line % n if "%s" in line else line for line in TALK) for n in NAMES]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")


def test_learned_from_the_corpus(spark):
    found = {r.term: r.n for r in abbreviations(talk(spark), "text").collect()}
    assert found == {"dr": 16, "u.s": 16}


def test_scores_by_hand(spark):
    got = {r.term: r for r in abbreviation_scores(talk(spark), "text").collect()}
    words, ends = 8 * 47, 8 * 9  # of each text 47 words, two "Dr.", two "U.S." and five others with a period behind them
    assert sum(r.with_period for r in got.values()) == ends
    p = ends / words
    fold = lambda c, o: 2 * (c * (math.log(0.99) - math.log(p)) + o * (math.log(0.01) - math.log(1 - p)))
    assert math.isclose(got["dr"].score, fold(16, 0) * math.exp(-2))
    assert math.isclose(got["u.s"].score, fold(16, 0) * math.exp(-2) * 2)
    train = got["train"]  # ends a sentence three times a text and stands inside one once
    assert (train.with_period, train.without) == (24, 8) and math.isclose(train.score, fold(24, 8) * math.exp(-5) * 5.0 ** -8)


def test_sentences_stay_whole(spark):
    listed = spark.createDataFrame([("dr", 9), ("u.s", 4), ("unused", 1)], "term STRING, n BIGINT")
    rows = [(1, "Dr. Able left. He (Dr. Cole) stayed!  Yes."), (2, "In the U.S.  it rains. Wait... Dr.\nDunn?"), (3, None), (4, ""),
            (5, "Dr. "), (None, "A. Dr. B."), (6, "我见 Dr. 王。他走了。")]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING")
    got = {}
    for r in sentences(docs, "text", listed=listed).orderBy("doc_id", "sent_no").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got == {1: ["Dr. Able left.", "He (Dr. Cole) stayed!", "Yes."], 2: ["In the U.S.  it rains.", "Wait...", "Dr.\nDunn?"],
                   5: ["Dr."], None: ["A.", "Dr.", "B."], 6: ["我见 Dr", "王", "他走了"]}
    plain = docs.select("doc_id", T.sentences(F.col("text")).alias("s"))
    same = docs.select("doc_id", T.sentences(F.col("text"), abbreviations=F.array().cast("array<string>")).alias("s"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, same.collect()))
    assert with_abbreviations(docs.limit(0), "text", listed, "doc_id").count() == 0
    assert abbreviations(docs.limit(0), "text").count() == 0


def test_job_keeps_sentences_whole(spark):
    page = lambda text: f"<html><body><h1>T</h1><article><p>{text}</p></article></body></html>"
    nav = "<html><body><nav><ul><li><a href='/a'>a</a></li></ul></nav></body></html>"
    body = " ".join(r.text for r in talk(spark).limit(3).collect())
    pages = spark.createDataFrame([(1, "http://t.test/1", nav), (2, "http://t.test/a", page(body))], PAGES)
    rules = site_rules(spark, "", sites=spark.createDataFrame([("t.test", "http://t.test/1")], "site STRING, start STRING"))
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    parsed = run(spark, rules, pages, spark.createDataFrame([], ARTICLES), as_of, abbreviations=True).parsed
    excerpt = parsed.filter("url LIKE '%/a'").first().excerpt
    assert excerpt and not any(s.strip().endswith("Dr.") for s in excerpt.split("\n"))
    whole = {line % n if "%s" in line else line for line in TALK for n in NAMES}
    left = excerpt
    for line in sorted(whole, key=len, reverse=True):
        left = left.replace(line, "")
    assert not left.strip()
