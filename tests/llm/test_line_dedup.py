"""Repeated runs against a plain version and against planted passages, and texts after removal."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from galley.llm import line_dedup, queries

DOCS = "doc_id BIGINT, text STRING"


def plain_spans(rows, least=line_dedup.RUN_WORDS, core=line_dedup.CORE_WORDS):
    """Units, first occurrences, runs and their ends by lists of words; no use of the operator's functions."""
    texts, first = {}, {}
    for key, text in rows:
        texts.setdefault(key, text or "")
    cut = {}
    for key in sorted(texts, key=lambda k: (k is not None, k or 0)):
        text, unit, cut[key] = texts[key], [], []
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\S+", text)]
        for i, (start, end, word) in enumerate(words):
            unit.append((start, end, word))
            last = i + 1 == len(words) or "\n" in text[end:words[i + 1][0]]
            if last or xxhash.xxh32_intdigest(word.encode()) % line_dedup.PIECE == 0 or len(unit) == line_dedup.PIECE_MOST:
                name = " ".join(w for *_, w in unit)
                first.setdefault(name, (key, unit[0][0], unit[-1][1]))
                cut[key].append((unit[0][0], unit[-1][1], len(unit), name))
                unit = []
    spans = []
    for key, held in cut.items():
        if key is None:
            continue
        flags, i = [first[n][:2] != (key, s) for s, _, _, n in held], 0
        found = []
        while i < len(held):
            j = i
            while j < len(held) and flags[j]:
                j += 1
            if j > i and sum(h[2] for h in held[i:j]) >= core:
                begin, end, n = held[i][0], held[j - 1][1], sum(h[2] for h in held[i:j])
                a, b = first[held[i][3]], first[held[j - 1][3]]
                before, other = texts[key][:begin], texts[a[0]][:a[1]]
                for x, y in zip([*re.finditer(r"\S+", before)][::-1], [*re.finditer(r"\S+", other)][::-1]):
                    if x[0].lower() != y[0].lower():
                        break
                    begin, n = x.start(), n + 1
                k = end
                for x, y in zip(re.finditer(r"\S+", texts[key][k:]), re.finditer(r"\S+", texts[b[0]][b[2]:])):
                    if x[0].lower() != y[0].lower():
                        break
                    end, n = k + x.end(), n + 1
                if n >= least:
                    found.append((begin, end))
            i = max(j, i + 1)
        for begin, end in sorted(found):
            if spans and spans[-1][0] == key and spans[-1][2] >= begin:
                spans[-1] = (key, spans[-1][1], max(end, spans[-1][2]))
            else:
                spans.append((key, begin, end))
    return sorted(spans)


def corpus(seed):
    deal = random.Random(seed)
    words = ["".join(deal.choices("abcdefgh", k=deal.randint(2, 6))) for _ in range(3000)] + ["É,", "日本", "x."]
    blank = lambda: deal.choices([" ", "  ", "\n", " \n\n"], [40, 1, 2, 1])[0]
    own = lambda n: "".join(w + blank() for w in deal.choices(words, k=n))
    passages = [deal.choices(words, k=deal.randint(51, 90)) for _ in range(6)]
    rows, planted = [], {}
    for i in range(120):
        text = own(deal.randint(20, 120))
        if i % 3 == 0:
            p = deal.choice(passages)
            begin = len(text)
            text += " ".join(p).upper() if i % 2 else " ".join(p)
            planted[i] = (begin, len(text), passages.index(p))
            text += deal.choice([" ", "\n"]) + own(deal.randint(0, 40))
        rows.append((i, text + "\nHome | About"))
    return rows, planted


def test_planted_passages_go_and_clean_texts_stay(spark):
    rows, planted = corpus(1)
    got = {}
    for r in line_dedup.repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    seen, removed = set(), 0
    for key, (begin, end, number) in sorted(planted.items()):
        if number in seen:
            removed += 1
            assert len(got[key]) == 1 and got[key][0][0] <= begin and got[key][0][1] >= end
            assert sum(b - a for a, b in got[key]) < 1.1 * (end - begin)
        else:
            assert key not in got
        seen.add(number)
    assert removed > 20 and set(got) <= set(planted)


def test_matches_the_plain_version(spark, tmp_path):
    rows, _ = corpus(2)
    rows += [(200, rows[4][1]), (201, rows[4][1].upper()), (202, ""), (203, None), (204, " \n "), (None, rows[9][1]), (205, rows[0][1] + " " + rows[0][1]),
             (206, "ab " * 5000), (207, "ab " * 3000), (208, "word " + " ".join(rows[7][1].split()) + " end")]
    want = plain_spans(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("KEY", "no", "start", "kept", "digest", "t", "at", "before")})
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op7_line_hash_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "end", "kept_doc_id", "kept_start"]
    assert sorted((r.doc_id, r.start, r.end) for r in got.collect()) == want and len(want) > 30
    low = lambda t: " ".join(t.lower().split())
    text = dict(rows)
    assert all(low(text[k][a:b]) for k, a, b in want)


def test_texts_lose_later_runs_only(spark):
    passage = " ".join(f"word{i} and{i * i}" for i in range(30))
    rows = [(2, f"Before it {passage} after it"), (1, passage), (3, "clean"), (4, None), (5, f"{passage}\n{passage}"), (5, "another row of that key")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id BIGINT, text STRING, removed STRING")
    got = {(r.doc_id, r.text and r.text.split()[0] if r.text and r.text.strip() else r.text) for r in line_dedup.drop_repeats(docs.filter("doc_id != 5")).collect()}
    assert got == {(1, "word0"), (2, "Before"), (3, "clean"), (4, None)}
    left = {r.doc_id: r.text for r in line_dedup.drop_repeats(docs.filter("doc_id < 5")).collect()}
    assert left[2] == "Before it  after it" and left[1] == passage
    alone = line_dedup.drop_repeats(docs.filter("doc_id = 5 AND text LIKE 'word%'")).first()
    assert alone.text.strip() == passage
    assert line_dedup.repeats(docs.filter("doc_id > 9")).count() == 0


def test_lines_and_paragraphs_as_units(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{line}\nown words\n\nmenu"), (2, f"x\n{line}\n\nmenu"), (3, f"{line} more")]
    for unit in ("line", "paragraph", "sentence"):
        got = {r.doc_id: (r.start, r.end) for r in line_dedup.repeats(spark.createDataFrame(rows, DOCS), unit=unit).collect()}
        assert set(got) == ({2} if unit != "paragraph" else set())


def test_units_keep_their_places():
    text = "  One two  three.\nfour\n\n five"
    assert [text[a:b] for a, b, *_ in line_dedup.cut(text, "line")] == ["One two  three.", "four", "five"]
    assert [n for *_, n, _ in line_dedup.cut(text, "line")] == [3, 1, 1]
