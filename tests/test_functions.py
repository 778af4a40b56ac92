"""Scalar expressions against hand-computed values."""

import random
import re
import time
from urllib.parse import urljoin

from pyspark.sql import functions as F

from galley.functions import dates, frontmatter, images, slugs, text, urls
from galley.operators.keyphrases import keyphrases_mmr
from galley.operators.segment import Automaton, build_automata, cut, longest_words, segment_cjk, transliterate


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


BASE = "http://a/b/c/d;p?q"
# RFC 3986 section 5.4
RFC = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    "./../g": "http://a/b/g", "g/./h": "http://a/b/c/g/h", "mailto:x@y": "mailto:x@y",
}


def test_url_join_examples(spark):
    rows = spark.createDataFrame(list(RFC.items()), "href STRING, expected STRING")
    got = {r.href: r.got for r in rows.select("href", urls.url_join(F.lit(BASE), F.col("href")).alias("got")).collect()}
    assert got == RFC
    plain = [h for h in RFC if h not in (";x",)]
    assert {h: urljoin(BASE, h) for h in plain} == {h: got[h] for h in plain}


def test_url_parts(spark):
    u = "https://me@h.org:81/a/b%20c+d.JPG/?q=1"
    assert one(spark, urls.site_key(F.lit(u))) == "me@h.org:81"
    assert one(spark, urls.url_basename(F.lit(u))) == "b c+d.JPG"
    assert one(spark, urls.guess_media_type(F.lit(u))) == "image/jpeg"


def test_titles_and_leadin(spark):
    assert one(spark, text.clean_title(F.lit(" 标题：题目 "))) == "目"
    assert one(spark, text.strip_leadin(F.lit("x\n【本文 简介】：内容"))) == "内容"


def test_cjk_and_noise(spark):
    assert one(spark, text.has_cjk(F.lit("a\U00020001b")))
    assert not one(spark, text.has_cjk(F.lit("abcé")))
    words = ["ab", "a", "12", "3.5%", "1e5", "--", "__", "a1", "中文"]
    rows = spark.createDataFrame([(w,) for w in words], "w STRING").filter(text.valid_keyword(F.col("w")))
    assert {r.w for r in rows.collect()} == {"ab", "a1", "中文"}


def test_clean_text_accents(spark):
    assert one(spark, text.clean_text(F.lit("café™ x"))) == "caf   x"
    assert one(spark, text.clean_text(F.lit("café™ x"), keep_accents=True)) == "café  x"


def test_ngrams_of_short_text(spark):
    a = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, text.ngrams(a)) == ["x", "y", "x y"]
    assert one(spark, text.ngrams(F.array().cast("array<string>"))) == []


def test_sentences(spark):
    assert one(spark, text.sentences(F.lit('One. "Two!" Three?  v1.2 four'))) == ["One.", '"Two!"', "Three?", "v1.2 four"]
    assert one(spark, text.sentences(F.lit("一。二；三！ "))) == ["一", "二", "三"]


def test_dates(spark):
    cases = {
        "2024年1月2日 10:05": "2024-01-02T10:05:00+0800", "2024年1月2日 下午3:05": "2024-01-02T15:05:00+0800",
        "2024-01-02 12:05上午": "2024-01-02T00:05:00+0800", "2024/1/2 03:04:05": "2024-01-02T03:04:05+0800",
        "2024年13月2日 10:05": None, "soon": None, "2024 1 2 下午15:00": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw STRING")
    got = {r.raw: r.v for r in rows.select("raw", dates.fmt_pubdate(dates.parse_pubdate(F.col("raw"))).alias("v")).collect()}
    assert got == cases


def test_slugs(spark):
    cases = {"Crème brûlée — it's 1,000 ß": "creme-brulee-it-s-1000-ss", "  --  ": "", "Ørsted & Łódź": "orsted-lodz"}
    for title, expected in cases.items():
        assert one(spark, slugs.slugify(F.lit(title))) == expected
    assert one(spark, slugs.slugify(F.lit("C++ and The C"), "_", ["the"], [["++", "pp"]])) == "cpp_and_c"


def test_watermark_and_extras(spark):
    assert one(spark, frontmatter.watermark(F.lit("中a"))) == "20013​097"
    assert one(spark, frontmatter.normalise_extra(F.lit("（012）"))) == "12"
    assert one(spark, frontmatter.normalise_extra(F.lit('a "b"'))) == 'a \\"b\\"'


def test_proxy_prefix_order(spark):
    assert one(spark, images.unwrap_image_url(F.lit("http://p/img.php?url=http://x/img.php?url=y"))) == "http://x"
    assert one(spark, images.unwrap_image_url(F.lit("http://a/api.php?pic=b/img.php?url=c"))) == "c"
    assert one(spark, images.is_hotlink_host(F.lit("https://img.alicdn.com/x")))


def test_split_tags(spark):
    tags = F.array(F.lit("a(b)"), F.lit("标签：c!"))
    assert one(spark, text.split_tags(tags)) == ["a", "b", "c"]


def test_segmenter_keeps_phrases_whole(spark):
    words = ["中文", "中文分词", "分", "词典", "python", None, "", "中文"]
    docs = spark.createDataFrame([(1, "中文分词很好"), (2, "用python写中文 词典abc"), (1, ""), (None, None)], "doc_id INT, text STRING")
    dictionary = spark.createDataFrame([(w,) for w in words], "term STRING")
    got = sorted([(r.doc_id, r.terms) for r in segment_cjk(docs, "text", dictionary).collect()], key=str)
    assert got == sorted([(1, ["中文分词", "很", "好"]), (2, ["用", "python", "写", "中文", "词典", "abc"]), (1, []), (None, None)], key=str)


def test_automata_walk_like_a_pattern():
    deal = random.Random(1)
    words = ["".join(deal.choices("中文字典词abc. ", k=deal.randint(1, 6))) for _ in range(400)]
    texts = ["".join(deal.choices("中文字典词分abc. _9-", k=deal.randint(0, 300))) for _ in range(60)] + ["", "中" * 100_000]
    pattern = re.compile("|".join(map(re.escape, sorted(words, key=lambda w: -len(w)))) + r"|[中文字典词分]|[a-z0-9_]+")
    parts = [Automaton(words[k::3]) for k in range(3)]
    start = time.perf_counter()
    got = [cut(t, n, re.compile(r"[中文字典词分]|[a-z0-9_]+")) for t, n in longest_words(texts, parts)]
    assert time.perf_counter() - start < 3
    assert got == [pattern.findall(t) for t in texts]
    assert list(longest_words(["中文"], [Automaton([])])) == [("中文", [0, 0])]


def test_long_tables_take_several_automata(spark):
    words = spark.createDataFrame([(f"词{i}",) for i in range(3000)], "term STRING")
    parts = build_automata(words, block_bytes=4000)
    assert len(parts) > 3
    assert [n for _, n in longest_words(["x词2999"], parts)] == [[0, 5, 0, 0, 0, 0]]


def test_phrases_read_as_a_whole(spark):
    titles = spark.createDataFrame([(1, "重庆重要银行行人ok银"), (2, ""), (3, None)], "id INT, t STRING")
    table = spark.createDataFrame([("重", "zhong"), ("要", "yao"), ("重庆", "chong-qing"), ("银行", "yin-hang"), ("行", "xing"),
                                   ("重庆人", "no"), ("行", "xing"), ("人", "ren")], "ch STRING, syllable STRING")
    got = {r.id: r.syllables for r in transliterate(titles, "t", table, "id").collect()}
    assert got == {1: "chong-qing-zhong-yao-yin-hang-xing-ren-ok-银"}


def test_transliterate(spark):
    titles = spark.createDataFrame([(1, "你好World吗")], "id INT, t STRING")
    table = spark.createDataFrame([("你", "ni"), ("好", "hao")], "ch STRING, syllable STRING")
    assert transliterate(titles, "t", table, "id").first().syllables == "ni-hao-World-吗"


def test_mmr_without_diversity_is_top_cosine(spark):
    vecs = {"a": [1.0, 0.0], "b": [0.9, 0.1], "c": [0.0, 1.0], "d": [-1.0, 0.0]}
    cands = spark.createDataFrame([(1, t, v) for t, v in vecs.items()], "doc_id INT, term STRING, vec ARRAY<DOUBLE>")
    docs = spark.createDataFrame([(1, [1.0, 0.05])], "doc_id INT, vec ARRAY<DOUBLE>")
    top = keyphrases_mmr(cands, docs, 3, 0.0).orderBy("rank").collect()
    assert [r.term for r in top] == ["a", "b", "c"]
    spread = keyphrases_mmr(cands, docs, 2, 0.9).orderBy("rank").collect()
    assert spread[1].term == "d"


def test_cut_slices_of_a_batch(spark):
    texts = [None, "", "ab \u7684\u4e00 cd", "x " * 300_000, None, "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    got = {r.doc_id: r.terms for r in segment_cjk(rows, "text", spark.createDataFrame([("\u7684\u4e00",)], "term STRING")).collect()}
    assert got[0] is None and got[4] is None and got[1] == [] and got[2] == ["ab", "\u7684\u4e00", "cd"] and got[5] == ["y"]
    assert len(got[3]) == 300_000


def test_mmr_partitions_grow_with_the_vectors(spark):
    cands = spark.range(4000).selectExpr("int(id % 50) AS doc_id", "'t' || id AS term", "transform(sequence(1, 2000), x -> double(x * id % 7)) AS vec")
    docs = spark.range(50).selectExpr("int(id) AS doc_id", "transform(sequence(1, 2000), x -> double(x % 5)) AS vec")
    found = keyphrases_mmr(cands, docs, 2)
    assert "hashpartitioning(doc_id" in found._jdf.queryExecution().toString()
    assert found.rdd.getNumPartitions() >= 4000 * 2000 * 16 // (16 << 20)
    assert found.count() == 100
