"""Near copies by verified similarity, against brute force."""

import random

import corpus_pipeline as P
from galley.llm import near_sets
from galley.llm.common import DOCUMENTS


def slow_kept(rows):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


def test_stage_matches_brute_force(spark):
    deal = random.Random(3)
    words = ["".join(deal.choices("abcdefgh", k=4)) for _ in range(400)]
    texts = [" ".join(deal.choices(words, k=deal.randint(30, 300))) for _ in range(40)]
    common = " ".join(deal.choices(words, k=60))  # a passage of many otherwise different texts
    texts += [f"{common} " + " ".join(deal.choices(words, k=deal.randint(10, 60))) for _ in range(40)]
    for _ in range(160):  # from nearly equal to below the similarity, partly in chains
        base = deal.choice(texts[:12] if deal.random() < 0.6 else texts).split()
        for _ in range(deal.randint(1, 6)):
            at = deal.randrange(len(base))
            base[at:at + deal.randint(0, 2)] = deal.choices(words, k=deal.randint(0, 9))
        texts.append(" ".join(base) or "x")
    short = " ".join(words[:7])
    texts += [short, " ".join([short, words[8]]), "", None, " \n", "One", "one", "a b", "b a"]
    deal.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    got = P.near_copies(spark, docs, "")
    assert got.columns == list(DOCUMENTS)
    assert sorted(r.doc_id for r in got.collect()) == slow_kept(rows)


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


def test_links_are_verified(spark):
    deal = random.Random(8)
    words = ["".join(deal.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = []
    for i in range(0, 60, 2):
        base = deal.choices(words, k=130)
        other = [f"{w}x" if at % 14 == 9 else w for at, w in enumerate(base)]
        rows += [(i, " ".join(base)), (i + 1, " ".join(other))]  # alike word by word, of five-word similarity below one half
    assert P.near_copies(spark, documents(spark, rows), "").count() == len(rows)


def test_a_passage_of_many_texts(spark):
    deal = random.Random(9)
    words = ["".join(deal.choices("abcdefgh", k=4)) for _ in range(4000)]
    passage = " ".join(deal.choices(words, k=70))
    rows = [(i, passage + " " + " ".join(deal.choices(words, k=deal.randint(10, 14)))) for i in range(5000)]
    rows += [(5000 + i, t + " more") for i, (_, t) in enumerate(rows[:50])]
    kept = {r.doc_id for r in P.near_copies(spark, documents(spark, rows), "").collect()}
    assert kept == set(range(5000))


def test_repeated_rows_and_names(spark):
    rows = [(3, "a b c"), (3, "a b c"), (3, "other words here"), (None, "a b c"), (None, None), (None, ""), (4, "A  B c")]
    docs = spark.createDataFrame([(k, t, 5, "x", "y") for k, t in rows], "doc_id BIGINT, text STRING, row1 INT, `key` STRING, near_sets_name STRING")
    got = near_sets.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(
        [(3, "a b c", 5, "x", "y"), (3, "other words here", 5, "x", "y"), *[r for r in got.collect() if r.doc_id is None]], key=str)
    assert [(r.text or "") for r in got.collect() if r.doc_id is None] == [""]
