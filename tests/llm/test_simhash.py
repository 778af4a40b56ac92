"""Fingerprints, pigeonhole blocks and components against brute force."""

import random
import string

import pytest
import xxhash

from galley.llm import queries, simhash

OPS = "op4_simhash_near_duplicates"


def slow_print(text, size=4):
    lowered = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = ""
        else:
            word += c
    runs = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    prints = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, f"{prints[i]:016x}", least.get(find(i))) for i, (key, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    deal = random.Random(11)
    words = ["".join(deal.choices("abcdeé", k=4)) for _ in range(300)]
    texts = [" ".join(deal.choices(words, k=deal.randint(1, 120))) for _ in range(60)]
    near = []
    for _ in range(120):  # near copies of a few texts, in chains
        base = (deal.choice(near) if near and deal.random() < 0.5 else deal.choice(texts[:6])).split()
        base[deal.randrange(len(base))] = deal.choice(words)
        near.append(" ".join(base))
    texts += near + [texts[0]] * 30 + ["", None, " \t\n", "ONE", "one", "A b\x0bc D", "long " * 40000]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5, "repeated row"), (5, "repeated row"), (None, texts[3])]


def test_query_matches_brute_force(spark, rows, tmp_path):
    frame = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id BIGINT, text STRING, fp INT, component_id STRING")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES[OPS](spark, str(tmp_path)).collect()), key=str)
    assert got == slow_components(rows)


def test_small_chunks_lose_no_link(spark):
    deal = random.Random(2)
    prints = {0, -1, 1 << 62, -(1 << 63)}
    base = deal.getrandbits(64) - (1 << 63)
    for _ in range(400):
        prints.add(base ^ sum(1 << deal.randrange(62) for _ in range(deal.randint(0, 5))))
    for radius, blocks in ((4, 6), (3, 5), (6, 9)):
        distinct = spark.createDataFrame([(p,) for p in prints], "fp BIGINT")
        edges = simhash.near_edges(distinct, radius, blocks, chunk=16)
        assert all(((a ^ b) & simhash.WORD).bit_count() for a, b in edges.collect())
        got = dict(map(tuple, simhash.connected(edges).collect()))
        seen, want = set(), {}
        for start in sorted(prints):
            stack = [start] if start not in seen else []
            while stack:
                p = stack.pop()
                if p not in seen:
                    seen.add(p)
                    want[p] = start
                    stack += [q for q in prints if ((p ^ q) & simhash.WORD).bit_count() <= radius]
        assert {p: got.get(p, p) for p in prints} == want


def test_long_paths_and_no_edges(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(7, 7)], "fp BIGINT, least BIGINT")
    assert {r.root for r in simhash.connected(path).collect()} == {0}
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(1, "a")], none.schema)).first().component_id == 1
