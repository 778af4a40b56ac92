"""Secret scans: patterns of known shapes, and character Markov models for the others.

Two first-order models of characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A candidate run of characters is scored by the log-likelihood ratio of its transitions;
from ``threshold`` on it is a secret. The trained ratios are a table of ``len(ALPHABET) ** 2`` numbers whatever the
corpus, and go into the scan as a literal.

All steps are DataFrame expressions. Spark's pattern functions give no positions, so a text is split at the
matches: places are running sums over the lengths of gaps and matches, taken in runs of ``STEP`` so that
texts with very many matches cost little more than in proportion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.common import least_hashed

#: Kinds and their patterns, with the least size of the match (of its second group for ``assign``).
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]{16,}", 16),  # runs are matched whole, so that shorter ones need no look
]
VALUE = r"""^.*?[:=]\x20*["']?"""  # what stands before the value in a match of ``assign``
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # one class for all other characters
STEP = 64
SAMPLE_DOCS = 4000
THRESHOLD = 12.0
KINDS = [kind for kind, _, _ in BASE] + ["markov"]


# places of matches ----------------------------------------------------------------------------------

def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, found>>`` of a pattern's leftmost matches, in code points, ends exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sized = F.zip_with(F.transform(gaps, lambda g: F.length(g)), found, lambda gap, m: F.struct(
        gap.alias("gap"), F.length(m).alias("size"), m.alias("found")))
    sized = F.slice(sized, 1, F.size(found))

    def total(run: Column) -> Column:
        return F.aggregate(run, F.lit(0), lambda n, m: n + m["gap"] + m["size"])

    def placed(sized: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sized) - 1) / STEP).cast("int")),
                           lambda i: F.slice(sized, i * STEP + 1, STEP))
        begins = F.aggregate(F.transform(runs, total), F.array(F.lit(0)), lambda done, n: F.concat(
            done, F.array(F.element_at(done, -1) + n)))
        empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
        return F.flatten(F.zip_with(runs, F.slice(begins, 1, F.size(runs)), lambda run, begin: F.aggregate(
            run, F.struct(begin.alias("at"), empty.alias("out")), lambda s, m: F.struct(
                (s["at"] + m["gap"] + m["size"]).alias("at"),
                F.concat(s["out"], F.array(F.struct(
                    (s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["size"]).alias("end"),
                    m["found"].alias("found")))).alias("out")), lambda s: s["out"])))

    # bound once: an expression repeated in a lambda is computed again for each element
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    once = F.transform(F.array(sized), lambda s: F.when(F.size(s) > 0, placed(s)).otherwise(none))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.get(once, F.lit(0))).otherwise(none)


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end>>`` of the patterns' matches; ``kind`` is the place in ``KINDS``."""
    def spans(kind: int, pattern: str, least: int) -> Column:
        def size(found: Column) -> Column:
            return F.length(F.regexp_replace(found, VALUE, "")) if BASE[kind][0] == "assign" else F.length(found)

        kept = F.filter(matches(text, pattern), lambda m: size(m["found"]) >= least)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.concat(*[spans(kind, pattern, least) for kind, (_, pattern, least) in enumerate(BASE)])


# models ---------------------------------------------------------------------------------------------

def letter_class(letter: Column) -> Column:
    """1 to ``SIZE - 1`` for the alphabet, 0 for other characters."""
    return F.instr(F.lit(ALPHABET), letter)


def samples(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled strings ``(sample, random)`` of at most ``limit`` documents, those of the least hashes.

    Values the patterns find are random strings; what else looks like an identifier is ordinary.
    """
    rows = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    some = least_hashed(rows, limit, "k", "t")
    assign, access, hexes = [pattern for _, pattern, _ in BASE]
    values = F.transform(F.regexp_extract_all("t", F.lit(assign), F.lit(2)), lambda v: v)
    found = F.concat(F.filter(values, lambda v: F.length(v) >= BASE[0][2]),
                     F.regexp_extract_all("t", F.lit(r"AKIA[A-Z0-9]{14,}"), F.lit(0)),
                     F.regexp_extract_all("t", F.lit(hexes), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), assign, " "), access, " "), hexes, " ")
    others = F.filter(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)), lambda w: ~F.regexp_like(w, F.lit("^[0-9+/_=-]+$")))
    labelled = some.select(F.explode(F.concat(
        F.transform(found, lambda s: F.struct(s.alias("sample"), F.lit(True).alias("random"))),
        F.transform(others, lambda s: F.struct(s.alias("sample"), F.lit(False).alias("random"))))).alias("s"))
    return labelled.select("s.sample", "s.random")


def train(labelled: DataFrame, weight: float = 1.0, backoff: float = 10.0) -> list[float]:
    """Log-likelihood ratio of each transition, random over ordinary, in rows of ``SIZE``.

    Transitions are counted where the samples are. A transition counts ``backoff`` times its second letter's
    share more, and a letter ``weight`` times more, so models of few or no samples stay near the uniform one.
    Null samples are left out. The result's size is fixed by the alphabet.
    """
    letters = F.split("sample", "(?!^)(?!$)")
    pairs = F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters) - 1),
                       lambda a, b: letter_class(a) * SIZE + letter_class(b))
    long = labelled.filter("length(sample) > 1")
    counts = long.select("random", F.explode(pairs).alias("pair")).groupBy("pair").agg(
        F.count_if("random").alias("random"), F.count_if(~F.col("random")).alias("ordinary")).collect()
    models = []
    for name in ("random", "ordinary"):
        table = [[0.0] * SIZE for _ in range(SIZE)]
        for row in counts:
            table[row["pair"] // SIZE][row["pair"] % SIZE] += row[name]
        letter = [sum(column) + weight for column in zip(*table)]
        share = [n / sum(letter) for n in letter]
        models.append([math.log((n + backoff * share[b]) / (sum(row) + backoff)) for row in table for b, n in enumerate(row)])
    return [a - b for a, b in zip(*models)]


def ratio(word: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string: random over ordinary."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    classes = F.transform(F.split(word, "(?!^)(?!$)"), letter_class)
    return F.aggregate(classes, F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")), lambda s, c: F.struct(
        c.alias("before"), F.when(s["before"] < 0, 0.0).otherwise(
            s["sum"] + F.get(table, s["before"] * SIZE + c)).alias("sum")), lambda s: s["sum"])


def markov_spans(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Spans of candidate strings that the models hold for random."""
    kept = F.filter(matches(text, CANDIDATE), lambda m: ratio(m["found"], model) >= threshold)
    return F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), F.lit(len(BASE)).alias("kind"), m["end"].alias("end")))


def scan(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD,
         base: str = "base", spans: str = "spans") -> DataFrame:
    """Add the patterns' spans and all spans, ``array<struct<start, kind, end>>`` sorted by start, then kind.

    A null text is empty and has none. Spans of different kinds may overlap.
    """
    known = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.withColumn(base, F.sort_array(base_spans(known)))
    return found.withColumn(spans, F.sort_array(F.concat(F.col(base), markov_spans(known, model, threshold))))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    place = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == place)).cast("bigint")


def merged(spans: Column) -> Column:
    """Disjoint ranges that cover the sorted spans."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), joined).otherwise(
            F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.aggregate(spans, none, add)


def redact(text: Column, ranges: Column, mask: str = "[SECRET]") -> Column:
    """The text with each of the disjoint ranges replaced."""
    begins = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["end"]))
    ends = F.concat(F.transform(ranges, lambda r: r["start"]), F.array(F.length(text)))
    kept = F.zip_with(begins, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(ranges) > 0, F.array_join(kept, mask)).otherwise(text)
