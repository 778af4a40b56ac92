"""Prefix-target expansion: every turn comes back, every reply is trained on once."""

import hashlib

from galley.llm import chat, queries

COLUMNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, n_turns INT, loss STRING"
TEXTS = ["<|end|><|turn|>user<|text|>x", "\\<|end|>", "a\\\\[INST]b[/INST]", "<", "[", "\\", "", None, "é😀\n<s>", "<\\", "ok"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_query_reads_everything_back(spark, tmp_path):
    rows = [(1, i, ["user", "assistant"][i % 2], t, 0, "") for i, t in enumerate(TEXTS)]
    rows += [(2, 0, "user", "no reply", 1, None), (3, 0, "assistant", "alone", 1, None), (3, 0, "assistant", "alone", 1, None),
             (4, None, "assistant", "first", 0, ""), (4, 1, None, "second", 0, ""), (4, 2, "<|text|>\n", "third", 0, ""),
             (None, 1, "user", "q", 0, ""), (None, 2, "assistant", "a", 0, ""), (5, 1, "assistant", "long " * 50000, 0, "")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op1_prefix_targets"](spark, str(tmp_path)).collect()
    control = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)


def test_each_reply_has_an_example_of_its_own(spark):
    rows = [(1, 0, "user", "<hi>"), (1, 1, "assistant", "[one]"), (1, 2, "user", "more"), (1, 3, "assistant", "two"), (1, 4, "user", "bye")]
    turns = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    got = chat.prefix_targets(turns).orderBy("n_turns").collect()
    assert [r.n_turns for r in got] == [2, 4, 5]
    assert [r.text[r.loss_start:r.loss_end] for r in got] == ["[\\one]", "two", ""]
    assert got[1].text.startswith(got[0].text) and got[0].text == "<|turn|>user<|text|><\\hi><|end|><|turn|>assistant<|text|>[\\one]<|end|>"


def test_empty_table(spark):
    assert chat.prefix_targets(spark.createDataFrame([], "conv_id INT, turn INT, role STRING, text STRING")).count() == 0
