"""Frontier, state, skew-safe joins and scoring properties."""

from pyspark.sql import functions as F

from galley.functions import text as T
from galley.operators import excerpt, filters, frontier, joins, scoring, segment
from galley.plans.run import pending_pages
from galley.schemas import ARTICLES
from galley.sources import (
    compact_articles, read_articles, read_documents, read_sites, read_stopwords, stopword_table, write_articles, write_documents,
)
from galley.sources.readers import compacted_batch


def test_reachable_listings(spark):
    edges = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("s", "s"), ("b1", "b2"), ("lost", "a1")] + [
        (f"c{i}", f"c{i + 1}") for i in range(20)]
    starts = spark.createDataFrame([("A", "a1"), ("S", "s"), ("B", "b1"), ("C", "c0")], "site STRING, url STRING")
    table = spark.createDataFrame(edges, "url STRING, next_url STRING")
    expected = {("A", "a1", 0), ("A", "a2", 1), ("A", "a3", 2), ("S", "s", 0), ("B", "b1", 0), ("B", "b2", 1)} | {
        ("C", f"c{i}", i) for i in range(21)}
    for rows in (None, 2):  # whole broadcast, and the split into heavy and other keys
        got = frontier.reachable_listings(table, starts, broadcast_rows=rows)
        assert {tuple(r) for r in got.select("site", "url", "hop").collect()} == expected


def test_lookup_join_forms_agree(spark):
    facts = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    lookup = facts.groupBy("k").agg(F.count("*").alias("n")).filter("k != 7")
    whole = joins.lookup_join(facts, lookup, "k", "n")
    split = joins.lookup_join(facts, lookup, "k", "n", broadcast_rows=1, hot_rows=3)
    assert sorted(map(tuple, whole.select("k", "id", "n").collect())) == sorted(map(tuple, split.select("k", "id", "n").collect()))


def _articles(spark, rows):
    empty = spark.createDataFrame([], ARTICLES)
    return empty.unionByName(spark.createDataFrame(rows, "url STRING, site STRING, publish BOOLEAN"), allowMissingColumns=True)


def test_discover_is_idempotent(spark):
    state = _articles(spark, [("u1", "s", True), ("u2", "s", None)])
    links = spark.createDataFrame([("s", "u1"), ("s", "u3"), ("s", "u3")], "site STRING, url STRING")
    once = frontier.add_discovered(state, links)
    assert {r.url for r in once.collect()} == {"u1", "u2", "u3"}
    assert frontier.discover(links, once).count() == 0
    assert [r.url for r in frontier.pending(once).collect()] == ["u3"]


def test_apply_parsed_never_inserts(spark):
    state = _articles(spark, [("u1", "s", False), ("u2", "s", False)])
    parsed = _articles(spark, [("u1", "s", True), ("u1", "s", True), ("new", "s", True)]).withColumn("title", F.lit("t"))
    rows = {r.url: (r.title, r.publish) for r in frontier.apply_parsed(state, parsed).collect()}
    assert rows == {"u1": ("t", True), "u2": (None, False)}


def test_weights_have_unit_norm(spark):
    docs = spark.createDataFrame([(1, "a1 b1 a1"), (2, "x1")], "doc_id INT, text STRING")
    weights = scoring.tf_l2(scoring.gram_counts(docs, T.tokens(F.col("text"))))
    norms = weights.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") ** 2), 9).alias("n")).collect()
    assert {r.n for r in norms} == {1.0}


def test_boost_uses_maximum_before_boosting(spark):
    scores = spark.createDataFrame([(1, "aa", 3.0), (1, "bb", 1.0)], "doc_id INT, term STRING, score DOUBLE")
    wanted = spark.createDataFrame([(1, "AA"), (1, "zz"), (2, "yy")], "doc_id INT, term STRING")
    got = {(r.doc_id, r.term): r.score for r in scoring.boost_required(scores, wanted).collect()}
    assert got == {(1, "aa"): 6.0, (1, "bb"): 1.0, (1, "zz"): 7.0, (2, "yy"): 1.0}


def test_excerpt_keeps_order(spark):
    body = "Red cats sleep. Dogs run far. Red cats run. Birds sing. Cats sleep far."
    docs = spark.createDataFrame([(1, body), (2, "!!!")], "doc_id INT, text STRING")
    rows = {r.doc_id: r.excerpt for r in excerpt.excerpt_bm25(docs, "text", 2).collect()}
    places = [body.index(s) for s in T_SENTS if s in rows[1]]
    assert len(places) == 2 and places == sorted(places)
    assert rows[2] == "!!!"


T_SENTS = ["Red cats sleep.", "Dogs run far.", "Red cats run.", "Birds sing.", "Cats sleep far."]


def test_block_list_matches_brute_force(spark):
    texts = ["abc hello world xyz", "the quick brown fox jumps", "short", "zzquick brown fox jumpzz", ""]
    phrases = ["quick brown fox jump", "or", "hello world", "absent phrase here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    listed = spark.createDataFrame([(p,) for p in phrases], "phrase STRING")
    kept = {r.doc_id for r in filters.drop_blocked(docs, "text", listed).collect()}
    assert kept == {i for i, t in enumerate(texts) if not any(p and p in t for p in phrases)}


def test_sources(spark, tmp_path):
    (tmp_path / "EnglishStopWords.txt").write_text("ZT  \n\nthe \n", encoding="utf-8")
    terms = read_stopwords(spark, str(tmp_path))
    assert {(r.lang, r.term) for r in terms.collect()} == {("en", "zt"), ("en", "the")}
    assert read_stopwords(spark, str(tmp_path / "none")).count() == 0
    assert stopword_table(spark, ["en"], terms).filter("term = 'the'").count() == 1
    (tmp_path / "sites.json").write_text(
        '[{"start_urls": ["http://me@h:8/x"], "selectors": {"article": {"extras": {}}, '
        '"remove": {"regex": ["<b", "(", ""]}}, "tokenizer": {"require": []}}]')
    site = read_sites(spark, str(tmp_path / "sites.json")).first()
    assert site.site == "me@h:8" and site.removal_pattern == "^(?:(?:<b))"


def test_dictionary_tokens(spark):
    texts = ["用c++写u.s.a代码", "abc中文字典abcdef d_1", "", None, "U.S.A. c+ +c++c"]
    words = ["c++", "u.s.a", "代码", "中文", "文字典", "abc", "字", "xx", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    got = dict(map(tuple, segment.segment_cjk(docs, "text", spark.createDataFrame([(w,) for w in words], "term STRING")).collect()))
    assert got == {0: ["用", "c++", "写", "u.s.a", "代码"], 1: ["abc", "中文", "字", "典", "abc", "def", "d_1"], 2: [], 3: None,
                   4: ["u.s.a", "c", "c++", "c"]}


def test_pages_go_by_the_state_s_site_and_least_id(spark):
    pages = spark.createDataFrame([(2, "http://b/1", "x"), (1, "http://b/1", "y"), (3, "http://b/2", "z")], "page_id BIGINT, url STRING, html STRING")
    state = _articles(spark, [("http://b/1", "a", False), ("http://b/2", None, False), ("http://b/3", "a", False)])
    got = {r.url: (r.site, r.html) for r in pending_pages(pages, state).collect()}
    assert got == {"http://b/1": ("a", "y"), "http://b/2": ("b", "z")}


def test_batches_stay_and_replace_themselves(spark, tmp_path):
    def docs(*rows):
        return spark.createDataFrame(rows, "site STRING, doc_name STRING, body STRING, n_bytes INT")

    path = str(tmp_path / "docs")
    write_documents(docs(("s", "a", "one", 3), ("s", "b", "old", 3)), path, 0)
    write_documents(docs(("s", "c", "wrong", 5)), path, 1)
    write_documents(docs(("s", "b", "new", 3)), path, 1)
    assert {(r.doc_name, r.body) for r in read_documents(spark, path).collect()} == {("a", "one"), ("b", "new")}


def test_a_version_counts_from_its_pointer_on(spark, tmp_path):
    path = str(tmp_path / "state")

    def marks():
        return {r.url: r.publish for r in read_articles(spark, path, ["publish"]).collect()}

    write_articles(_articles(spark, [("a", "s", False), ("b", "s", False)]), path, 0)
    write_articles(_articles(spark, [("a", "s", True)]), path, 1)
    before = marks()
    write_articles(_articles(spark, [("a", "s", False), ("z", "s", True)]), f"{path}/_base", 1)  # a compaction that broke off
    assert marks() == before == {"a": True, "b": False}
    compact_articles(spark, path)
    assert marks() == before and compacted_batch(spark, path) == 1
    write_articles(_articles(spark, [("a", "s", False)]), path, 0)  # batches up to the version are not read
    write_articles(_articles(spark, [("b", "s", True)]), path, 2)
    assert marks() == {"a": True, "b": True}
    compact_articles(spark, path)
    compact_articles(spark, path)
    assert marks() == {"a": True, "b": True} and compacted_batch(spark, path) == 2



def test_grams_match_a_plain_count(spark):
    from collections import Counter

    rows = [(1, ["b", "a", "b", "a", "c"]), (1, ["a", "b"]), (2, []), (3, None), (None, ["é", "a"]), (None, ["a"]), (4, ["x y", "z", "x"]), (5, ["q", None, "q"]), (6, ["a"])]
    docs = spark.createDataFrame(rows, "doc_id INT, terms ARRAY<STRING>")
    for given in (rows, [r for r in rows if r[0] not in (1, None)], [(i, [f"t{j % 40:02}" for j in range(100_000)]) for i in range(5)]):
        want = Counter()
        for key, terms in given:
            for n in range(1, 4):
                for i in range(len(terms or []) - n + 1):
                    want[key, terms[i] if n == 1 else " ".join(t for t in terms[i:i + n] if t is not None)] += 1
        docs = spark.createDataFrame(given, "doc_id INT, terms ARRAY<STRING>")
        grams = scoring.gram_counts(docs, F.col("terms"), low=1, high=3).collect()
        assert {(r.doc_id, r.gram): r.tf for r in grams} == want and len(grams) == len(want)
        assert all(r.n == (None if r.gram is None else r.gram.count(" ") + 1) for r in grams)
        top = {}
        for r in grams:
            top.setdefault((r.doc_id, r.n), []).append((-r.tf, r.gram or "", r.gram))
        few = scoring.gram_counts(docs, F.col("terms"), low=1, high=3, best=1).collect()
        found = {}
        for r in few:
            found.setdefault((r.doc_id, r.n), []).append((-r.tf, r.gram or "", r.gram))
        assert {k: min(v) for k, v in found.items()} == {k: min(v) for k, v in top.items()}
        assert all(r.total == sum(g.tf for g in grams if g.doc_id == r.doc_id) for r in few)


def test_shares_of_text_do_not_grow(spark):
    from galley.operators.joins import PART_BYTES, spread, text_bytes

    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('ab ', 1000) AS text", "array('x', 'yz') AS terms")
    assert text_bytes(docs, "doc_id") == 40 * 3003
    assert spread(docs, "doc_id", 9 * PART_BYTES).rdd.getNumPartitions() == 9


def test_tfidf_by_parts_matches_a_plain_count(spark):
    import math
    from collections import Counter

    rows = [(1, ["b", "a", "b", "a", "c"]), (1, ["a", "d"]), (2, []), (3, None), (4, ["é", "x y", "x"]), (5, ["q", None, "q", "b"])]
    rows += [(i, [f"t{i * j % 7}" for j in range(1, 5)]) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id INT, terms ARRAY<STRING>")
    texts = {}
    for key, terms in rows:
        texts.setdefault(key, []).extend(terms or [])
    df = Counter(t for terms in texts.values() for t in set(terms))
    given = {"a": 0.5, "b": -1.0, "t1": 2.0}
    for idf, table in (({t: math.log(len(rows) / n) for t, n in df.items()}, None), ({t: given.get(t, 0.5) for t in df}, given)):
        table = table and spark.createDataFrame(list(table.items()), "term STRING, idf DOUBLE")
        want = set()
        for key, terms in texts.items():
            found = [(-tf / len(terms) * idf[t], t, tf) for t, tf in Counter(terms).items() if t is not None]
            want |= {(key, t, tf, round(-s, 9), i) for i, (s, t, tf) in enumerate(sorted(found)[:3], 1)}
        got = scoring.tfidf_topk(docs, F.col("terms"), table, k=3)
        assert {(r.doc_id, r.term, r.tf, round(r.score, 9), r["rank"]) for r in got.collect()} == want
    # no row per document and term is moved by term: the parts' lists hold a term once
    placed, listed = scoring.term_parts(docs, F.col("terms"))
    assert listed.groupBy("part", "term").count().filter("count > 1").isEmpty()
    assert listed.count() < placed.select(F.explode("codes")).count()
    assert placed.groupBy("part").cogroup(listed.groupBy("part")).applyInArrow(lambda a, b: a.select(["KEY"]), "KEY INT").count() == placed.count()


def test_sentences_scored_in_a_row_match_those_scored_as_rows(spark):
    texts = [f"Alpha beta w{i % 3}. Beta beta gamma! x{i} The the. ... Alpha w{i % 5} delta? Last one w{i}" for i in range(30)] + ["", None, "One.", "..."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (3, "Beta. Beta gamma."), (None, "Alpha. Beta.")], "doc_id INT, text STRING")
    got = excerpt.bm25_sentences(docs, "text", stop=["the"])
    assert "ArrowEvalPython" in got._jdf.queryExecution().toString()
    words = T.drop_terms(T.tokens(F.col("sentence"), 1), ["the"])
    rows = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.sent_no, round(r.score, 9)) for r in df.collect())
    assert rows(got) == rows(excerpt.bm25_sentences(docs, "text", terms=words)) and len(rows(got)) > 100


def test_keywords_need_rows_of_single_and_required_terms(spark):
    from galley.operators.keywords import article_keywords

    docs = spark.createDataFrame([(1, ["aa", "bb", "aa", "cc"], ["Bb aa"]), (2, ["aa", "dd"], ["dd"])], "doc_id INT, terms ARRAY<STRING>, required ARRAY<STRING>")
    whole = {(r.doc_id, r.gram): (r.tf, r.total, r.squares) for r in scoring.gram_counts(docs, F.col("terms")).filter("n = 1").collect()}
    few = scoring.gram_counts(docs, F.col("terms"), most=1).collect()
    assert {(r.doc_id, r.gram): (r.tf, r.total, r.squares) for r in few} == whole and len(few) == len(whole)
    got = {(r.doc_id, r.term): r.score for r in article_keywords(docs, F.col("terms"), "doc_id", "required").collect()}
    norm = scoring.tf_l2(scoring.gram_counts(docs, F.col("terms"))).filter("gram = 'bb aa'").first().weight
    assert set(got) == {(1, "aa"), (1, "bb"), (1, "cc"), (1, "bb aa"), (2, "aa"), (2, "dd")} and abs(got[1, "bb aa"] - 2 * norm) < 1e-9
