"""Long block lists against plain search, and exact medians."""

import random
import statistics

from pyspark.sql import functions as F

from galley.operators import blocklist, filters, scoring


def corpus(seed: int, n: int):
    pick = random.Random(seed)
    common = "the common opening of every phrase, "
    texts = ["".join(pick.choice("ab c你") for _ in range(pick.randrange(120))) for _ in range(n)]
    phrases = ["".join(pick.choice("ab c你") for _ in range(pick.choice([6, 9, 16, 17, 40]))) for _ in range(60)]
    phrases += [common + str(i) for i in range(40)]
    for i in range(0, n, 9):
        p = pick.choice(phrases)
        texts[i] += p if i % 2 else p[:-1] + "x"
    return texts + [None, "", common], phrases + [None, "", phrases[0]]


def test_rare_windows_match_plain_search_in_several_passes(spark):
    texts, phrases = corpus(1, 300)
    wanted = {i for i, t in enumerate(texts) if t and any(p and p in t for p in phrases)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").repartition(3)
    listed = spark.createDataFrame([(p,) for p in phrases], "phrase STRING")
    for size, held in ((blocklist.BLOCK_BYTES, 4), (300, 2)):
        rows = blocklist.mark_blocked(docs, "text", listed, block_bytes=size, pass_blocks=held).collect()
        assert {r.doc_id for r in rows if r.blocked} == wanted and len(rows) == len(texts)
    assert 0 < len(wanted) < len(texts)


def test_rows_are_judged_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a bad one", 0), (1, "fine", 0), (None, "bad", 1), (None, None, 2)], "k INT, text STRING, _blocked INT")
    listed = spark.createDataFrame([("bad",), ("bad one, said at length",)], "phrase STRING")
    kept = filters.drop_blocked(docs.drop("_blocked"), "text", listed).collect()
    assert sorted((str(r.k), str(r.text)) for r in kept) == [("1", "fine"), ("None", "None")]
    assert [r.k for r in filters.blocked_ids(docs, "k", "text", listed).orderBy("k").collect()] == [None, 1]
    none = listed.limit(0)
    assert filters.drop_blocked(docs.drop("_blocked"), "text", none).count() == 4


def test_windows_avoid_what_is_common(spark):
    docs = spark.createDataFrame([("the common opening of every phrase",)] * 50, "text STRING")
    table = blocklist.gram_table(docs, "text")
    phrase = "the common opening of every phrase, zq8#kw0!xv7@jy5%"
    assert table.sum() == 50 * (34 - 3)
    at = blocklist.rarest_window(phrase, table)
    assert phrase[at:at + blocklist.WINDOW_CHARS] not in "the common opening of every phrase"


def test_median_is_that_of_all_values(spark):
    pick = random.Random(3)
    for values in ([1.5], [2.0, 1.0], [0.0] * 50 + [1e-300, 7.0], [pick.gauss(0, 1) ** 9 for _ in range(2001)], [float(i % 7) for i in range(200)]):
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "x DOUBLE")
        assert scoring.exact_median(rows, "x") == statistics.median(values)
        assert scoring.value_at(rows.filter("x IS NOT NULL"), "x", len(values) // 3, ranges=3) == sorted(values)[len(values) // 3]
    assert scoring.exact_median(spark.range(0).select(F.lit(None).cast("double").alias("x")), "x") is None
