"""The pipeline's stages against brute force on a small corpus."""

import random

import corpus_pipeline as P
from galley.llm import simhash
from galley.llm.bpe import ByteBPE
from galley.llm.common import DOCUMENTS

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
SECRET = 'password = "Zk39fjQ02mmPq81xT"'


def corpus():
    deal = random.Random(12)
    words = ["".join(deal.choices("abcdefghij", k=deal.randint(3, 8))) for _ in range(600)]
    rows, bad = [], set()
    for i in range(240):
        some = deal.choices(words, k=deal.randint(40, 160))
        text = " ".join(some)
        if i % 4 == 3:
            text = " | ".join(some[:40]) if i % 8 == 3 else "!! ".join(some).upper()
            bad.add(i)
        rows.append((i, text))
    items = [(0, " ".join(deal.choices(words, k=30))), (1, " ".join(deal.choices(words, k=18)))]
    extra = [rows[0][1], rows[0][1], rows[1][1] + " more", rows[2][1].replace(rows[2][1].split()[9], "edited", 1),
             f"before {items[0][1]} and " + rows[4][1][::-1], f"{rows[5][1][::-1]} {SECRET}; then", None, "", "one"]
    rows += [(1000 + i, t) for i, t in enumerate(extra)]
    rows = [(i, t, "en", f"src{(i or 0) % 3 + 3 * (i in bad)}", len(t or "")) for i, t in rows]
    return rows + [rows[8], rows[8]], items, bad


def test_stages(spark, tmp_path):
    rows, items, bad = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(160)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(
        str(tmp_path / "labels.parquet"))
    folder, seen = str(tmp_path), {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        if name != P.STAGES[-1][0]:
            assert docs.columns == list(DOCUMENTS)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    kept = [set(rows) for rows in seen.values()]
    assert not kept[0] & bad and {i for i in range(240)} - bad <= kept[0]
    assert kept[1] == {i for i in kept[0] if i not in (1000, 1001, 1002, 1003)} - ({1007} if {1006, 1007} <= kept[0] else set())
    assert spark.read.parquet(f"{tmp_path}/{P.STAGES[1][0]}").count() == len(kept[1])  # repeated rows are gone
    assert kept[1] - kept[2] == {1004}
    assert kept[3] == kept[2] == kept[4]
    before, after = seen["benchmark decontamination"], seen["secret scans"]
    assert {i for i in kept[3] if before[i].text != after[i].text} == {1005}
    assert after[1005].text == before[1005].text.replace(SECRET[:-1], "[SECRET]")
    library = ByteBPE(P.public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.ids == library.encode(after[i].text or "").tolist() for i, r in seen["BPE encoding"].items())
    whole = P.run(spark, folder).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in whole} == {(i, tuple(r.ids)) for i, r in seen["BPE encoding"].items()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_one_of_each_keeps_the_least_key(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (3, "other words here now"), (None, "x y"), (None, "x y"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = sorted(map(tuple, simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(3, "a b c d"), (3, "other words here now"), (None, "x y"), (None, None)], key=str)
