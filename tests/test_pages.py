"""Shredding, selecting, editing and rendering of small pages."""

import pytest
from pyspark.sql import functions as F

from galley.functions import dom
from galley.operators.shred import parse_nodes, shred
from galley.sources.readers import decode_bytes, read_html_files

PAGE = """<html><head><meta name="description" content="Hi &amp; you"><title>T</title></head><body>
<nav class="pagination x"><a href="/1">1</a><a href="/2" data-x='q"r'>2</a></nav>
<article class="post a-b" id="m"><h1> Title </h1><p><b> bold </b>text<br>more<p>second <i>it</i></p>
<ul><li>one<ul><li>in1<li>in2</ul><li><p>two</p></ul><blockquote><p>q1</p><p>q2</p></blockquote>
<pre>a
  b</pre><picture><source srcset=x><img src="/p.png" alt=old></picture><!-- c --><script>var t="</p>";</script></article>"""
N = "nodes"


@pytest.fixture(scope="module")
def tree(spark):
    rows = spark.createDataFrame([(1, "http://h/x", PAGE)], "page_id INT, url STRING, html STRING")
    return shred(rows).withColumn("root", dom.select_one(F.col(N), "#m")).cache()


def test_nodes_nest():
    nodes = parse_nodes("<p>a<b>x<p>y</b><table><tr><td>1<td>2</table>")
    assert [n[5] for n in nodes if n[4] == "elem"] == ["html", "body", "p", "b", "p", "table", "tr", "td", "td"]
    for pre, post, parent, *_ in nodes:
        assert post >= pre and (parent < 0 or nodes[parent][1] >= post)
    assert parse_nodes("") == [] and parse_nodes(None) == []


@pytest.mark.parametrize("selector, texts", [
    ("nav.pagination > a:last-child", ["2"]), ("a[href='/1'], a[data-x]", ["1", "2"]), ("article.post.a-b > h1", [" Title "]),
    ("li > p", ["two"]), ("ul ul li:first-child", ["in1"]), ("div", []), ("", []), ("a:nth-child(2)", []), ("a[href$='2']", ["2"]),
])
def test_selectors(tree, selector, texts):
    got = tree.select(dom.texts(F.col(N), dom.select(F.col(N), selector)).alias("t")).first().t
    assert got == texts


def test_text_skips_scripts(tree):
    text = tree.select(dom.node_text(F.col(N), F.col("root")).alias("t")).first().t
    assert "var t" not in text and " Title " in text and " c " not in text


def test_html_is_stable(spark, tree):
    html = tree.select(dom.to_html(F.col(N), F.col("root")).alias("h")).first().h
    again = shred(spark.createDataFrame([(1, "u", html)], "page_id INT, url STRING, html STRING"))
    assert again.select(dom.to_html(F.col(N), dom.select_one(F.col(N), "#m")).alias("h")).first().h == html


def test_markdown(tree):
    edited = tree.withColumn(N, dom.unwrap_pictures(F.col(N), F.col("root")))
    markdown = edited.select(dom.to_markdown(F.col(N), F.col("root"), F.lit("W")).alias("m")).first().m
    assert markdown.split("\n\n") == [
        "Title\n=====", "**bold** text  \nmore", "second *it*", "* one\n  + in1\n  + in2\n* two", "> q1\n>\n> q2",
        "```\na\n  b\n```", markdown.split("\n\n")[6]]
    assert "![old](/p.png)" in markdown and "W" in markdown


def test_meta_and_removal(tree):
    assert tree.select(dom.meta_content(F.col(N), "description").alias("d")).first().d == "Hi & you"
    steps = dom.selector_list_steps(F.array(F.lit("ul"), F.lit(""), F.lit("pre")))
    left = tree.withColumn(N, dom.drop_matches(F.col(N), steps, F.col("root")))
    text = left.select(dom.node_text(F.col(N), F.col("root")).alias("t")).first().t
    assert "one" not in text and "q1" in text


def test_html_files_in_several_charsets(spark, tmp_path):
    page = "<html><head>{}</head><body>中文 é</body></html>"
    files = {"gbk": (page.format('<meta charset="gbk">'), "gbk"), "utf16": (page.format(""), "utf-16"), "utf8": (page.format(""), "utf-8"),
             "mark": (page.format('<meta charset="gbk">'), "utf-8-sig"), "odd": (page.format('<meta charset="no-such">'), "utf-8"),
             "quoted": (page.format("<META http-equiv=a content='text/html; CHARSET=GB2312'>"), "gb18030"),
             "lies": (page.format('<meta charset="utf-16">'), "utf-8")}
    (tmp_path / "s.test").mkdir()
    for name, (text, charset) in files.items():
        (tmp_path / "s.test" / name).write_bytes(text.encode(charset))
    (tmp_path / "s.test" / "empty").write_bytes(b"")
    got = {r.url: r.html for r in read_html_files(spark, str(tmp_path)).collect()}
    assert got == {f"https://s.test/{name}": text for name, (text, _) in files.items()}
    assert decode_bytes("é".encode("latin-1"), "latin1") == "é" and decode_bytes(b"\xff") == "\ufffd"

