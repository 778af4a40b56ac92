"""Archives read back by hand and by the operator."""

import base64
import hashlib

import zstandard

from galley.llm import queries, warc

COLUMNS = "page_id BIGINT, url STRING, html STRING, first STRING, digest INT, n INT"


def fixture():
    rows = [(i, f"http://h/{i}", f"<p>page {i % 40} with some text that repeats</p>" * 5) for i in range(120)]
    rows += [(500, "http://h/é x\r\nX: y", ""), (501, None, None), (200, "http://big", "<i>é😀</i>" * 60000),
             (300, "http://n", "line\r\n\r\nline"), (None, "http://none", "only null"), (7, "http://h/7", "same id other text"),
             (None, "http://h/0", "<p>page 0 with some text that repeats</p>" * 5)]
    return rows


def expected(rows, least=0):
    out, groups = [], {}
    for i, (page_id, url, html) in enumerate(rows):
        groups.setdefault(html or "", []).append(((page_id is None, page_id or 0, url is None, url or ""), i))
    for i, (page_id, url, html) in enumerate(rows):
        data = (html or "").encode()
        first = min(groups[html or ""])[1] if len(data) >= least else i
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if first == i else "revisit", None if first == i else rows[first][0]))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op6_zstd_warc"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_files_are_plain_warc_zst(spark, tmp_path):
    rows = fixture()
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"), least_bytes=20)
    files = {}
    for r in spark.read.parquet(str(tmp_path / "w")).orderBy("archive", "part").collect():
        files[r.archive] = files.get(r.archive, b"") + bytes(r.data)
    seen = 0
    for data in files.values():
        assert int.from_bytes(data[:4], "little") == 0x184D2A5D
        dictionary, at = warc.leading_frame(data)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        text = b""
        with reader.stream_reader(data[at:], read_across_frames=True) as stream:
            text = stream.read()
        seen += text.count(b"WARC/1.1\r\n")
        assert b"\r\nX: y" not in text
    assert seen == len(rows)
    got = warc.read_archives(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows, 20)
    texts = {r.page_id: bytes(r.payload).decode() for r in got.filter("record_type = 'response' and page_id > 150").collect()}
    assert texts[200] == "<i>é😀</i>" * 60000 and texts[300] == "line\r\n\r\nline"


def test_equal_rows_have_one_response(spark):
    rows = [(1, "u", "text")] * 30 + [(2, "u", "text")] * 3
    got = warc.archive(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").repartition(5)).collect()
    assert len(got) == 33 and [r.page_id for r in got if r.record_type == "response"] == [1]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1}


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")).count() == 0
