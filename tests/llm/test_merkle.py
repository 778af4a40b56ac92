"""Merkle manifests against a plain recursion over lists."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from galley.llm import merkle, queries

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def proofs(nodes):
    """Root, and per node its siblings by level as (before, behind)."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a:a + 16]
            for k in range(len(run)):
                for i in under[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha("".join(run)))
            held.append([i for u in under[a:a + 16] for i in u])
        nodes, under = above, held
    return nodes[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = proofs([x[2] for x in groups[name]])
    root, tops = proofs([trees[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        subroot, paths = trees[name]
        for (_, _, digest, row), path in zip(groups[name], paths):
            path = path + top
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None
            folded = leaf(row, row[1].translate(LOWER)) if tampered else digest
            for before, behind in path:
                folded = sha(before + folded + behind)
            out.append((row[0], digest, subroot, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def corpus():
    deal = random.Random(5)
    rows = []
    for i in range(700):
        source = "hot" if i % 3 else deal.choice([None, "", "a", "é", "z", "Z", "ü", "日本", "solo", "=", "-"] + [f"s{j}" for j in range(20)])
        rows.append((i, deal.choice(["Abc Def", "", None, "é" * 30, "ALL UPPER", "lower only"]), "en", source, deal.choice([None, 7])))
    rows += [rows[1]] * 40 + [(None, "No Key", None, "hot", 1), (None, "No Key", None, "hot", 1), (None, None, None, None, None)]
    return rows + [(5, "another Text with the same key", "en", "hot", 3), (9000, "x" * 200_000 + "Y", "en", "one of its kind", 1)]


def found(spark, tmp_path, rows, name):
    folder = tmp_path / name
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("g", "pos", "H", "key", "path")}).repartition(3) \
        .write.parquet(str(folder / "documents.parquet"))
    return queries.QUERIES["op13_merkle_manifest"](spark, str(folder)), folder


def test_manifest_matches_brute_force_and_sql(spark, tmp_path):
    rows = corpus()
    df, folder = found(spark, tmp_path, rows, "many")
    got = sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    sql = con.execute(queries.ORACLES["op13_merkle_manifest"])
    order = [[d[0] for d in sql.description].index(c) for c in df.columns]
    assert sorted([tuple(r[i] for i in order) for r in sql.fetchall()], key=str) == sorted([tuple(r) for r in df.collect()], key=str)


def test_small_tables(spark, tmp_path):
    for size in (0, 1, 2, 16, 17):
        rows = [(i, f"Text {i}", "en", "s", 1) for i in range(size)]
        df, _ = found(spark, tmp_path, rows, f"of{size}")
        columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        assert sorted([tuple(r) for r in df.select(*columns).collect()], key=str) == (brute(rows) if rows else [])


def test_level_count():
    assert [merkle.level_count(n) for n in (None, 0, 1, 2, 16, 17, 256, 257)] == [0, 0, 1, 2, 2, 3, 3, 4]
