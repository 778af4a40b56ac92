"""Tokens, n-gram weights and keyword scores.

Texts are shuffled once, by document, before they are taken apart: tokens and n-grams are several
times larger than the text. A document's n-grams are counted in its own row, by the numbers of its tokens; strings are made
for the different ones only, so that none is hashed, sorted or moved for the count.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.functions.bind import compute_once
from galley.operators.abbreviations import with_abbreviations
from galley.operators.joins import BROADCAST_ROWS, is_small, small_broadcast, spread, text_bytes
from galley.session import written_once


#: Tokens that are counted together in a task.
SLICE_TOKENS = 1 << 18
#: Tokens of a part whose documents share a list of their terms.
PART_TOKENS = 1 << 22
#: Characters that could stand in a token and make two different sequences one string, or order them otherwise than their tokens.
ODD_TOKEN = r"[\x00-\x20]"
COUNTED = "struct<odd:boolean,total:bigint,squares:bigint,grams:array<struct<at:int,n:int,tf:int>>>"


def tokenize(df: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """``(key, pos, term)``."""
    return df.select(key, F.posexplode(T.tokens(F.col(column))).alias("pos", "term"))


def sentences(df: DataFrame, column: str, key: str = "doc_id", listed: DataFrame | None = None) -> DataFrame:
    """``(key, sent_no, sentence)``; none ends behind an abbreviation of ``listed``, a table ``(term, n)``."""
    if listed is None:
        return df.select(key, F.posexplode(T.sentences(F.col(column))).alias("sent_no", "sentence"))
    known = with_abbreviations(df.select(key, column), column, listed, key, "_abbreviations")
    parts = T.sentences(F.col(column), abbreviations=F.col("_abbreviations"))
    return known.select(key, F.posexplode(parts).alias("sent_no", "sentence"))


def remove_stopwords(tokens: DataFrame, stopwords: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Tokens that are no stop words; a required word stays although it is listed.

    With a ``lang`` column on both sides each language has its own list.
    """
    on = ["lang", "term"] if "lang" in tokens.columns and "lang" in stopwords.columns else ["term"]
    listed = stopwords.select(*on).distinct()
    if required is not None:
        listed = listed.join(required.select("term").distinct(), "term", "left_anti")
    return tokens.join(small_broadcast(listed), on, "left_anti")


def _plain_grams(codes: np.ndarray, doc: np.ndarray, left: np.ndarray, low: int, high: int, best: int | None):
    """``(doc, at, n, tf)`` of the different n-grams of token numbers; ``left`` counts the tokens from each place to its row's end.

    A gram's number is made of its prefix's and its last token's, in the order of the tokens, so grams of a size sort by it.
    """
    base, place, number, out = int(codes.max(initial=0)) + 1, np.arange(len(codes)), doc, []
    for n in range(1, high + 1):
        inside = left[place] >= n
        place, number = place[inside], number[inside] * base + codes[place[inside] + n - 1]
        _, first, number, tf = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        if n < low:
            continue
        at = place[first]
        if best is not None:  # numbers ascend by document and then by gram: a stable sort leaves equal counts in that order
            order = np.lexsort((-tf, doc[at]))
            owner = doc[at[order]]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
            order = order[rank < best]
            at, tf = at[order], tf[order]
        out.append((doc[at], at, np.full(len(at), n, np.int32), tf))
    return [np.concatenate(c) for c in zip(*out)]


def _odd_grams(rows: list[list[str | None]], low: int, high: int) -> list[tuple[int, int, int]]:
    """``(at, n, tf)`` of one document's different n-grams as strings, for tokens that hold blanks or are null."""
    seen, places, begin = Counter(), {}, 0
    for row in rows:
        for n in range(low, high + 1):
            for i in range(len(row) - n + 1):
                gram = row[i] if n == 1 else " ".join(t for t in row[i:i + n] if t is not None)
                seen[gram] += 1
                places.setdefault(gram, (begin + i, n))
        begin += len(row)
    return [(*places[gram], tf) for gram, tf in seen.items()]


def _count_slice(lists, low: int, high: int, best: int | None, most: int | None = None):
    """The column of ``COUNTED`` for documents, each a list of token arrays."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = lists.flatten()
    tokens = rows.flatten()
    per_row = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row_doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    doc, ends = np.repeat(row_doc, per_row), np.cumsum(per_row)
    left = np.repeat(ends, per_row) - np.arange(len(tokens))
    known = tokens.dictionary_encode()
    order = pc.sort_indices(known.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    strange = pc.match_substring_regex(known.dictionary, ODD_TOKEN).to_numpy(zero_copy_only=False)
    codes = pc.fill_null(known.indices, -1).to_numpy(zero_copy_only=False)
    bad = np.append(strange, True)[codes]  # -1, null, is the last
    odd = np.zeros(len(lists), bool)
    odd[doc[bad]] = True
    plain = ~odd[doc]
    starts = np.searchsorted(doc, np.arange(len(lists)), "left")
    # places of odd documents count as past their row's end, so that only plain ones are left
    found = _plain_grams(np.append(rank, 0)[codes].astype(np.int64), doc, np.where(plain, left, 0), low, high, None)
    extra = [(d, starts[d] + at, n, tf) for d in np.flatnonzero(odd) for at, n, tf in _odd_grams(lists[int(d)].as_py(), low, high)]
    if extra:
        found = [np.concatenate([a, np.array(b, a.dtype)]) for a, b in zip(found, zip(*extra))]
    owner, _, _, tf = found
    total = np.bincount(owner, tf, len(lists)).astype(np.int64)
    squares = np.zeros(len(lists), np.int64)
    np.add.at(squares, owner, tf.astype(np.int64) ** 2)
    if best is not None:
        kept = _plain_grams(np.append(rank, 0)[codes].astype(np.int64), doc, np.where(plain, left, 0), low, high, best)
        whole = odd[found[0]]
        found = [np.concatenate([a, b[whole]]) for a, b in zip(kept, found)]
    if most is not None:
        stay = (found[2] <= most) | odd[found[0]]
        found = [c[stay] for c in found]
    order = np.argsort(found[0], kind="stable")
    owner, at, n, tf = (c[order] for c in found)
    grams = pa.StructArray.from_arrays([pa.array((at - starts[owner]).astype(np.int32)), pa.array(n.astype(np.int32)),
                                        pa.array(tf.astype(np.int32))], names=["at", "n", "tf"])
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(lists)))).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(odd), pa.array(total), pa.array(squares), pa.ListArray.from_arrays(pa.array(offsets), grams)],
                                      names=["odd", "total", "squares", "grams"])


def _counter(low: int, high: int, best: int | None, most: int | None = None):
    import pyarrow as pa

    @F.arrow_udf(COUNTED)
    def counted(lists):
        import pyarrow.compute as pc

        rows = pc.fill_null(pc.list_value_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        slices = np.cumsum(np.bincount(doc, rows, len(lists))) // SLICE_TOKENS
        cuts = np.append(np.flatnonzero(np.diff(slices, prepend=-1)), len(lists))
        parts = [_count_slice(lists.slice(a, b - a), low, high, best, most) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.concat_arrays(parts) if parts else pa.array([], _count_slice(lists, low, high, best).type)

    return counted


def token_lists(docs: DataFrame, terms: Column, key: str = "doc_id") -> DataFrame:
    """``(key, _lists)``: the token arrays of all rows of a key, in partitions whose number grows with the bytes of text."""
    rows = spread(docs, key, text_bytes(docs, key)).select(key, terms.alias("_terms"))
    if docs.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty():
        return rows.select(key, F.array(F.coalesce("_terms", F.array().cast("array<string>"))).alias("_lists"))  # nothing to bring together
    return rows.groupBy(key).agg(F.collect_list("_terms").alias("_lists"))


def gram_counts(docs: DataFrame, terms: Column, key: str = "doc_id", low: int = 1, high: int = 6, best: int | None = None,
                most: int | None = None) -> DataFrame:
    """``(key, gram, n, tf, total, squares)`` of the token arrays that ``terms`` yields on each row.

    Rows with equal keys are one document. ``total`` and ``squares`` are the sums of the document's counts and of their squares.
    With ``best`` all n-grams are counted, and rows are made of at least the ``best`` ones of each size, by count and then by gram.
    With ``most`` all are counted too, and rows are made of at least those of up to ``most`` tokens.
    """
    lists = compute_once(token_lists(docs, terms, key), _lists=F.col("_lists"))
    found = lists.select(key, F.flatten("_lists").alias("_words"), _counter(low, high, best, most)("_lists").alias("_c"))
    one = found.select(key, "_words", F.col("_c.odd").alias("_odd"), F.col("_c.total").alias("total"), F.col("_c.squares").alias("squares"),
                       F.explode_outer("_c.grams").alias("_g")).filter("_g IS NOT NULL")  # a plain one would count twice, to filter first
    word = lambda j: F.get("_words", F.col("_g.at") + j)
    several = F.concat_ws(" ", *[word(0), *[F.when(F.col("_g.n") > j, word(j)) for j in range(1, high)]])
    one = one.select(key, "_odd", F.when(F.col("_g.n") == 1, word(0)).otherwise(several).alias("gram"), "_g.n",
                     F.col("_g.tf").cast("bigint").alias("tf"), "total", "squares")
    blanks = (F.length(F.regexp_replace("gram", "[^ ]", "")) + 1).cast("int")
    return one.select(key, "gram", F.when(F.col("_odd"), blanks).otherwise(F.col("n")).alias("n"), "tf", "total", "squares")


def tf_l2(grams: DataFrame, key: str = "doc_id") -> DataFrame:
    """Weight of each n-gram in its document: count over the document's Euclidean norm."""
    whole = F.col("squares") if "squares" in grams.columns else F.sum(F.col("tf") * F.col("tf")).over(W.partitionBy(key))
    rows = grams.withColumn("weight", F.col("tf") / F.sqrt(whole))
    return rows.drop("total", "squares")


def term_idf(counts: DataFrame, n_docs: Column, term: str = "term") -> DataFrame:
    """``(term, df, idf)`` with idf = ln(N / df), from one row per (document, term)."""
    seen = counts.groupBy(term).agg(F.count("*").alias("df"))
    return seen.withColumn("idf", F.ln(n_docs.cast("double") / F.col("df")))


def value_at(df: DataFrame, column: str, rank: int, ranges: int = 4096) -> float:
    """The value at a place, from zero, of a column of finite doubles in ascending order.

    Each round counts the rows of equal ranges and goes on in the one that holds the place, so neither a task nor the driver
    holds more than ``ranges`` rows.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        scaled = F.floor((F.col(column) - low) / (high - low) * ranges).cast("int")
        counted = df.groupBy(F.least(scaled, F.lit(ranges - 1)).alias("range")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for part in sorted(counted.collect()):
            if rank < part.n:
                break
            rank -= part.n
        low, high = part.low, part.high
        df = df.filter(F.col(column).between(low, high))
    return low


def exact_median(df: DataFrame, column: str) -> float | None:
    """Median of the values that are not null, the mean of the middle two if their number is even; null without any."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    n = values.count()
    if not n:
        return None
    below, above = value_at(values, "v", (n - 1) // 2), None if n % 2 else value_at(values, "v", n // 2)
    return below if above is None else (below + above) / 2


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def _coded(low_tokens: int):
    """Documents as ``(key, lists of tokens)`` to the rows of ``term_parts``: a part's terms, then its documents."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            keys = pa.concat_arrays([h[0] for h in held])
            words = pa.chunked_array([h[2] for h in held]).unify_dictionaries()
            known = words.chunk(0).dictionary
            order = pc.sort_indices(known).to_numpy()  # numbers in the order of the terms, so that ties go by number
            rank = np.empty(len(order) + 1, np.int64)
            rank[order], rank[-1] = np.arange(len(order)), -1  # null, the last, is counted in the total alone
            codes = rank[np.concatenate([pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False) for c in words.chunks])]
            begins = np.cumsum([0] + [len(h[0]) for h in held])
            doc = np.concatenate([h[1] + at for h, at in zip(held, begins)])
            base, total = max(len(order), 1), np.bincount(doc, minlength=len(keys))
            number, tf = np.unique((doc * base + codes)[codes >= 0], return_counts=True)
            owner, code = number // base, number % base
            sizes = np.bincount(owner, minlength=len(keys))
            some = np.flatnonzero(sizes)
            offsets = pa.array(np.append(0, np.cumsum(sizes[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in (code, tf)]
            for n, columns in ((len(order), {"term": known.take(pa.array(order)), "code": pa.array(np.arange(len(order), dtype=np.int32)),
                                             "docs": pa.array(np.bincount(code, minlength=len(order)))}),
                               (len(some), {"KEY": keys.take(pa.array(some)), "codes": lists[0], "tfs": lists[1], "total": pa.array(total[some])})):
                columns["part"] = pa.array(np.full(n, part, np.int64))
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        for batch in batches:
            lists = batch.column(1)
            rows = lists.flatten()
            per_row = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row_doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            kind = batch.column(0).type
            schema = pa.schema([("part", pa.int64()), ("KEY", kind), ("codes", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
                                ("total", pa.int64()), ("term", pa.string()), ("code", pa.int32()), ("docs", pa.int64())])
            held.append((batch.column(0), np.repeat(row_doc, per_row), rows.flatten().cast(pa.string()).dictionary_encode()))
            tokens += int(per_row.sum())
            if tokens >= low_tokens:
                yield from flush()
                part, held, tokens = part + 1, [], 0
        if tokens:
            yield from flush()

    return run


def term_parts(docs: DataFrame, terms: Column, key: str = "doc_id", part_tokens: int = PART_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Counts of the token arrays that ``terms`` yields, by parts of some ``part_tokens`` tokens that number their own terms.

    The documents are ``(part, KEY, codes, tfs, total)``, the terms ``(part, term, code, docs)`` with the part's documents that hold
    one; codes ascend with the terms. Rows with equal keys are one document; one without a token has no row.
    """
    schema = f"part BIGINT, KEY {_key_type(docs, key)}, codes ARRAY<INT>, tfs ARRAY<INT>, total BIGINT, term STRING, code INT, docs BIGINT"
    found = written_once(token_lists(docs, terms, key).mapInArrow(_coded(part_tokens), schema))
    return (found.filter("codes IS NOT NULL").select("part", "KEY", "codes", "tfs", "total"),
            found.filter("term IS NOT NULL").select(F.col("part").alias("part"), "term", "code", "docs"))


def _best_terms(k: int):
    def run(docs, terms):
        import pyarrow as pa
        import pyarrow.compute as pc

        terms = terms.sort_by("code").combine_chunks()
        code, idf = terms["code"].to_numpy(), terms["idf"].to_numpy().astype(float)
        docs = docs.combine_chunks()
        codes, tfs = (pc.list_flatten(docs[c]).to_numpy() for c in ("codes", "tfs"))
        sizes = pc.list_value_length(docs["codes"]).to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # a supplied table may hold a term more than once, as a join would find it
        begin, rows = np.searchsorted(code, codes, "left"), np.searchsorted(code, codes, "right")
        rows -= begin
        if not (rows == 1).all():
            within = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
            begin, owner, codes, tfs = (np.repeat(c, rows) for c in (begin, owner, codes, tfs))
            begin = begin + within
        score = tfs / docs["total"].to_numpy()[owner] * idf[begin]
        none = terms["idf"].is_null().to_numpy()[begin]
        odd = np.isnan(score)  # above all numbers; a null is below them
        order = np.lexsort((codes, np.where(odd, 0.0, -score), np.where(none, 2, np.where(odd, 0, 1)), owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner, "left") + 1
        order, owner, rank = order[rank <= k], owner[rank <= k], rank[rank <= k]
        return pa.Table.from_arrays([
            docs["KEY"].take(pa.array(owner)), terms["term"].take(pa.array(begin[order])), pa.array(tfs[order].astype(np.int64)),
            pa.array(score[order], mask=none[order]), pa.array(rank.astype(np.int32))], ["KEY", "term", "tf", "score", "rank"])

    return run


def tfidf_topk(
    docs: DataFrame,
    terms: Column,
    idf: DataFrame | None = None,
    k: int = 500,
    key: str = "doc_id",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Top ``k`` terms per document by tf/total · idf: ``(key, term, tf, score, rank)``.

    Without an idf table (``term, idf``) the corpus gives it. Of a supplied table, terms it lacks
    take its median. Documents stay in the parts that number their terms; a part gets the weights of its own terms, so
    what is moved by term is a row per part and term, and no term has more rows than there are parts.
    """
    placed, listed = term_parts(docs, terms, key)
    if idf is None:
        n_docs = docs.select(F.count("*").alias("n")).scalar()
        df = F.sum("docs").over(W.partitionBy("term"))
        weights = listed.withColumn("idf", F.ln(n_docs.cast("double") / df))
    else:
        given = idf.select("term", F.col("idf").cast("double").alias("idf"))
        if is_small(given, broadcast_rows):
            given = F.broadcast(given)
        weights = listed.join(given, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(exact_median(idf, "idf"))))
    weights = weights.select(F.col("part").alias("part"), "term", "code", "idf")
    best = placed.groupBy("part").cogroup(weights.groupBy("part")).applyInArrow(
        _best_terms(k), f"KEY {_key_type(docs, key)}, term STRING, tf BIGINT, score DOUBLE, rank INT")
    return best.withColumnRenamed("KEY", key)


def combine_scores(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Product of two score tables ``(key, term, score)`` over their common terms."""
    left = a.select(key, "term", F.col("score").alias("_a"))
    right = b.select(key, "term", F.col("score").alias("_b"))
    return left.join(right, [key, "term"]).select(key, "term", (F.col("_a") * F.col("_b")).alias("score"))


def merge_required(scores: DataFrame, tf: DataFrame, required: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add required terms that occur in the document but have no score, at their tf weight.

    ``required`` is ``(key, term)`` or, for all documents alike, ``(term)``.
    """
    on = [key, "term"] if key in required.columns else ["term"]
    wanted = required.select(*[F.lower(c).alias(c) if c == "term" else F.col(c) for c in on]).distinct()
    rows = tf.select(key, "term", F.col("weight").alias("score"))
    if on == ["term"]:
        missing = rows.join(small_broadcast(wanted), on, "left_semi").join(scores.select(key, "term"), [key, "term"], "left_anti")
    else:  # what has a score goes first, from the smaller table, so that the counts are moved once
        missing = rows.join(wanted.join(scores.select(key, "term"), on, "left_anti"), on, "left_semi")
    return scores.select(key, "term", "score").unionByName(missing)


def boost_required(scores: DataFrame, required: DataFrame, key: str = "doc_id") -> DataFrame:
    """Double the score of a required term that has one; give the others 2·max + 1.

    ``required`` is ``(key, term)``. The maximum is the document's before any boost, 0 if it has no
    scores. Both tables fold into one grouping by (document, term).
    """
    rows = scores.select(key, "term", "score", F.lit(False).alias("wanted")).unionByName(
        required.select(key, F.lower("term").alias("term"), F.lit(None).cast("double").alias("score"),
                        F.lit(True).alias("wanted"))
    )
    folded = (
        spread(rows, key).groupBy(key, "term")
        .agg(F.max("score").alias("score"), F.bool_or("wanted").alias("wanted"))
    )
    top = F.coalesce(F.max("score").over(W.partitionBy(key)), F.lit(0.0))
    boosted = F.when(
        F.col("wanted"),
        F.when(F.coalesce("score", F.lit(0.0)) != 0, F.col("score") * 2).otherwise(top * 2 + 1),
    ).otherwise(F.col("score"))
    return folded.withColumn("_boosted", boosted).select(key, "term", F.col("_boosted").alias("score"))


def rank_keywords(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keywords that are no noise, by score, then length, then term: ``(key, term, score, rank)``."""
    order = W.partitionBy(key).orderBy(F.desc("score"), F.desc(F.length("term")), "term")
    kept = scores.filter(T.valid_keyword(F.col("term")))
    return kept.select(key, "term", "score").withColumn("rank", F.row_number().over(order))
