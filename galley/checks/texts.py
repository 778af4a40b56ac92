"""Text analytics over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galley.checks.registry import (
    ARTICLE, ARTICLE_HTML, GRAMS, H1, check, sql_list, sql_text, table, tokens_sql,
)
from galley.checks.stopwords import STOPWORDS
from galley.functions import text as T
from galley.functions.bind import compute_once, let
from galley.operators import abbreviations, excerpt, filters, keyphrases, phrases, scoring, segment
from galley.operators.articles import choose_excerpt, choose_tags
from galley.session import written_once

DOC_TOKENS = tokens_sql("text")
STOP_SQL = "(VALUES " + ", ".join(
    f"('{lang}', {sql_text(w)})" for lang, words in STOPWORDS.items() for w in words
) + ") s(lang, term)"
ENGLISH_SQL = sql_list(STOPWORDS["en"])


def page_fields(spark, folder):
    """Title and article text of pages by pattern: no Python in the way."""
    pages = table(spark, folder, "pages")
    article = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)

    def decode(c):
        return F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))

    return pages.select(
        "page_id", "url",
        decode(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("title"),
        decode(F.regexp_replace(article, "<[^>]*>", " ")).alias("body"),
    )


@check(rf"""
WITH p AS (SELECT page_id, {H1} AS title,
    {ARTICLE.replace("'<[^>]*>', ''", "'<[^>]*>', ' '")} AS body FROM pages),
  k AS (SELECT page_id, unnest({tokens_sql("body")}) AS term FROM p),
  c AS (SELECT page_id, term, count(*) AS tf FROM k WHERE term NOT IN ({ENGLISH_SQL}) GROUP BY ALL),
  s AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY page_id)) AS score FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(term) DESC, term) AS rank
        FROM s WHERE length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+(\.[0-9]+)?%?$|^[0-9]+e[+-]?[0-9]+$|^_+$'))
SELECT p.page_id, p.title, coalesce(string_agg(r.term, ',' ORDER BY r.rank), '') AS keywords
FROM p LEFT JOIN r ON p.page_id = r.page_id AND r.rank <= 5 GROUP BY p.page_id, p.title
""")
def keywords_top5(spark, folder):
    fields = page_fields(spark, folder)
    terms = T.drop_terms(T.tokens(F.col("body")), list(STOPWORDS["en"]))
    grams = scoring.gram_counts(fields.select("page_id", "body"), terms, "page_id", 1, 1)
    scores = scoring.tf_l2(grams, "page_id").select("page_id", F.col("gram").alias("term"), F.col("weight").alias("score"))
    top = scoring.rank_keywords(scores, "page_id").filter("rank <= 5")
    lists = top.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("k"))
    return fields.select("page_id", "title").join(lists, "page_id", "left").select(
        "page_id", "title", F.coalesce(F.array_join(F.transform("k", lambda x: x["term"]), ","), F.lit("")).alias("keywords"))


@check("""
SELECT doc_id, regexp_matches(text, '[一-龥㐀-䶿]') AS plain,
  regexp_matches(translate(text, 'ñß', '中㐀'), '[一-龥㐀-䶿]') AS mixed FROM documents
""")
def cjk_flag(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.has_cjk(F.col("text")).alias("plain"),
                       T.has_cjk(F.translate("text", "ñß", "中㐀")).alias("mixed"))


@check(r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text,
    '[^a-zA-Z0-9\x{4e00}-\x{9fa5}\s\-.''@#$%&*+/:;=?~(){}`_、。，《》？！“”‘’（）—…]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS body
  FROM documents)
SELECT doc_id, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS digest FROM c
""")
def clean_text_docs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", T.clean_text(F.col("text")).alias("body"))
    return docs.select("doc_id", F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("digest"))


@check(f"""
WITH t AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
  md5(array_to_string(w, ' ')) AS digest FROM t
""")
def tokenize_docs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"),
                       F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
                       F.md5(F.array_join("w", " ")).alias("digest"))


SENTENCES = r"""
  s0 AS (SELECT {key} AS doc_id, string_split(regexp_replace(text, '([.!?]+["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM {src}),
  s1 AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM s0),
  sents AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS sent_no FROM s1)
"""


@check(f"""
WITH {SENTENCES.format(key="conv_id * 1000 + turn", src="conversations")}
SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, sentence FROM sents
""")
def sentence_split(spark, folder):
    turns = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return scoring.sentences(turns, "text")


ABBREVIATIONS = r"""
  words AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+(?:\.\p{L}+)*\.?')) AS w FROM documents),
  types AS (SELECT rtrim(w, '.') AS term, count(*) FILTER (WHERE w LIKE '%.') AS c, count(*) FILTER (WHERE w NOT LIKE '%.') AS o FROM words GROUP BY ALL),
  chance AS (SELECT sum(c) / sum(c + o) AS p FROM types),
  weighed AS (SELECT *, length(replace(term, '.', '')) AS n, 2 * (c * (ln(0.99::DOUBLE) - ln(p)) + o * (ln(1 - 0.99::DOUBLE) - ln(1 - p))) AS likely
              FROM types, chance WHERE c > 0),
  abbr AS (SELECT term, c AS with_period, o AS without, likely * exp(-n) * (length(term) - n + 1) * pow(n, -o) AS score FROM weighed)
"""


@check(f"WITH {ABBREVIATIONS} SELECT term, with_period, without, round(score, 6) + 0.0 AS score FROM abbr")
def abbreviation_scores(spark, folder):
    scores = abbreviations.abbreviation_scores(table(spark, folder, "documents"), "text")
    return scores.withColumn("score", F.round("score", 6) + 0.0)


@check(rf"""
WITH {ABBREVIATIONS}, known AS (SELECT list(term) AS terms FROM abbr WHERE score >= 0.3),
  s0 AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]+["'')\]]*)(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents),
  s1 AS (SELECT doc_id, string_split(array_to_string(list_transform(p, lambda x: x || CASE WHEN list_contains(terms,
      regexp_extract(lower(x), '(\p{{L}}+(?:\.\p{{L}}+)*)\.$', 1)) THEN '' ELSE chr(1) END), ''), chr(1)) AS p FROM s0, known),
  s2 AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM s1)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_sents, md5(array_to_string(p, '|')) AS digest FROM s2
""")
def sentence_split_abbreviations(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    known = abbreviations.with_abbreviations(docs, "text", abbreviations.abbreviations(docs, "text"), "doc_id")
    sents = T.sentences(F.col("text"), cjk=F.lit(False), abbreviations=F.col("abbreviations"))
    return known.select("doc_id", sents.alias("p")).select(
        "doc_id", F.size("p").cast("bigint").alias("n_sents"), F.md5(F.array_join("p", "|")).alias("digest"))


@check(r"""
WITH s AS (SELECT doc_id, string_split_regex(translate(text, '.,', '。，'), '[。！？.!?，；\x{3000}]') AS p FROM documents),
  f AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM s)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_sents, md5(array_to_string(p, '|')) AS digest FROM f
""")
def sentence_split_cjk(spark, folder):
    docs = table(spark, folder, "documents")
    sents = T.sentences(F.translate("text", ".,", "。，"), cjk=F.lit(True))
    return docs.select("doc_id", sents.alias("p")).select(
        "doc_id", F.size("p").cast("bigint").alias("n_sents"), F.md5(F.array_join("p", "|")).alias("digest"))


@check(f"""
WITH t AS (SELECT doc_id, lang, unnest({DOC_TOKENS}) AS term FROM documents),
  a AS (SELECT doc_id, count(*) AS n_tokens FROM t GROUP BY ALL),
  k AS (SELECT doc_id, count(*) AS n_kept FROM t WHERE NOT EXISTS (
          SELECT 1 FROM {STOP_SQL} WHERE s.lang = t.lang AND s.term = t.term) GROUP BY ALL)
SELECT a.doc_id, n_tokens, coalesce(n_kept, 0) AS n_kept FROM a LEFT JOIN k USING (doc_id)
""")
def stopword_ratio(spark, folder):
    docs = table(spark, folder, "documents")
    kept = F.col("w")
    for lang, words in STOPWORDS.items():
        kept = F.when(F.col("lang") == lang, T.drop_terms(F.col("w"), list(words))).otherwise(kept)
    rows = docs.select("doc_id", "lang", T.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(kept).cast("bigint").alias("n_kept"))


@check(f"""
WITH t AS (SELECT doc_id, unnest({DOC_TOKENS}) AS term FROM documents)
SELECT term, count(*) AS n FROM t WHERE term NOT IN ({ENGLISH_SQL}) OR term IN ('the', 'and', 'of') GROUP BY ALL
""")
def stopwords_keep_required(spark, folder):
    tokens = scoring.tokenize(table(spark, folder, "documents"), "text")
    required = spark.createDataFrame([("the",), ("and",), ("of",)], "term STRING")
    kept = scoring.remove_stopwords(tokens, spark.createDataFrame([(w,) for w in STOPWORDS["en"]], "term STRING"), required)
    return kept.groupBy("term").agg(F.count("*").alias("n"))


@check(f"""
WITH t AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents), {GRAMS}
SELECT doc_id, CAST(n AS INTEGER) AS n, gram, tf FROM c
QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY tf DESC, gram) = 1
""")
def ngrams_1_6_top(spark, folder):
    grams = scoring.gram_counts(table(spark, folder, "documents").select("doc_id", "text"), T.tokens(F.col("text")), best=1)
    order = W.partitionBy("doc_id", "n").orderBy(F.desc("tf"), "gram")
    return grams.withColumn("r", F.row_number().over(order)).filter("r = 1").select("doc_id", "n", "gram", "tf")


@check(f"""
WITH t AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents), {GRAMS},
  x AS (SELECT doc_id, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS weight FROM c)
SELECT doc_id, count(*) AS n_grams, round(sum(weight * weight), 6) AS norm, round(max(weight), 6) AS top FROM x GROUP BY ALL
""")
def tf_l2_norm_check(spark, folder):
    grams = scoring.gram_counts(table(spark, folder, "documents").select("doc_id", "text"), T.tokens(F.col("text")))
    weights = scoring.tf_l2(grams)
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("n_grams"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"),
        F.round(F.max("weight"), 6).alias("top"))


TFIDF = f"""
  t AS (SELECT doc_id, unnest({DOC_TOKENS}) AS term FROM documents),
  c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  d AS (SELECT term, ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / count(*)) AS idf FROM c GROUP BY ALL),
  x AS (SELECT doc_id, term, tf, tf / sum(tf) OVER (PARTITION BY doc_id) * idf AS score FROM c JOIN d USING (term))
"""


@check(f"""
WITH {TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM x)
SELECT doc_id, term, tf, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20
""")
def tfidf_topk(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scoring.tfidf_topk(docs, T.tokens(F.col("text")), k=20).withColumn("score", F.round("score", 6))


@check(f"""
WITH t AS (SELECT doc_id, unnest({DOC_TOKENS}) AS term FROM documents),
  c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  b AS (SELECT item_id, unnest({DOC_TOKENS}) AS term FROM benchmark),
  d AS (SELECT term, ln(1000.0::DOUBLE / count(DISTINCT item_id)) AS idf FROM b GROUP BY ALL),
  x AS (SELECT doc_id, term, tf, tf / sum(tf) OVER (PARTITION BY doc_id) *
          coalesce(idf, (SELECT quantile_disc(idf, 0.5) FROM d)) AS score FROM c LEFT JOIN d USING (term)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM x)
SELECT doc_id, term, tf, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def tfidf_supplied_idf(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    given = scoring.tokenize(table(spark, folder, "benchmark"), "text", "item_id").groupBy("term").agg(
        F.ln(F.lit(1000.0) / F.count_distinct("item_id")).alias("idf"))
    return scoring.tfidf_topk(docs, T.tokens(F.col("text")), given, k=5).withColumn("score", F.round("score", 6))


@check(f"""
WITH {TFIDF},
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM x),
  l AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS weight FROM c)
SELECT doc_id, term, round(r.score * l.weight, 6) AS score FROM r JOIN l USING (doc_id, term) WHERE rank <= 10
""")
def combined_scores(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    first = scoring.tfidf_topk(docs, T.tokens(F.col("text")), k=10)
    weights = scoring.tf_l2(scoring.gram_counts(docs, T.tokens(F.col("text")), low=1, high=1))
    second = weights.select("doc_id", F.col("gram").alias("term"), F.col("weight").alias("score"))
    return scoring.combine_scores(first, second).withColumn("score", F.round("score", 6))


REQUIRED = f"""
  q AS (SELECT DISTINCT doc_id, unnest(list_concat(w[1:2], ['the', 'zz-none'])) AS term
        FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents)),
  r AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 10),
  l AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS weight FROM c),
  m AS (SELECT doc_id, term, score FROM r UNION ALL
        SELECT l.doc_id, l.term, l.weight FROM l JOIN q USING (doc_id, term)
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.term = l.term))
"""


def _required_inputs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # the scores and the words go into several joins
    scores = written_once(scoring.tfidf_topk(docs, T.tokens(F.col("text")), k=10).select("doc_id", "term", "score"))
    grams = scoring.tf_l2(scoring.gram_counts(docs, T.tokens(F.col("text")), low=1, high=1)).withColumnRenamed("gram", "term")
    words = compute_once(docs, w=T.tokens(F.col("text"))).select("doc_id", F.slice("w", 1, 2).alias("w"))
    wanted = written_once(words.select("doc_id", F.explode(F.concat("w", F.array(F.lit("the"), F.lit("zz-none")))).alias("term")).distinct())
    return scores, grams, wanted


@check(f"WITH {TFIDF}, {REQUIRED} SELECT doc_id, term, round(score, 6) AS score FROM m")
def required_merge(spark, folder):
    scores, grams, wanted = _required_inputs(spark, folder)
    return scoring.merge_required(scores, grams, wanted).withColumn("score", F.round("score", 6))


@check(rf"""
WITH {TFIDF}, {REQUIRED},
  o AS (SELECT coalesce(m.doc_id, q.doc_id) AS doc_id, coalesce(m.term, q.term) AS term, m.score, q.term IS NOT NULL AS wanted
        FROM m FULL JOIN q ON m.doc_id = q.doc_id AND m.term = q.term),
  b AS (SELECT doc_id, term, CASE WHEN NOT wanted THEN score WHEN coalesce(score, 0) <> 0 THEN score * 2
          ELSE coalesce(max(score) OVER (PARTITION BY doc_id), 0) * 2 + 1 END AS score FROM o)
SELECT doc_id, term, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(term) DESC, term) AS INTEGER) AS rank
FROM b WHERE length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$|^_+$')
""")
def required_boost(spark, folder):
    scores, grams, wanted = _required_inputs(spark, folder)
    boosted = scoring.boost_required(scoring.merge_required(scores, grams, wanted), wanted)
    return scoring.rank_keywords(boosted).withColumn("score", F.round("score", 6))


NOISE = ["", "%", "e5", ".5%", "__", " a", "-"]


@check("""
WITH k AS (SELECT p_partkey * 10 + i AS id, CASE WHEN i < 7 THEN CAST(p_size AS VARCHAR) || v ELSE p_name END AS term
  FROM part, (VALUES (0, ''), (1, '%'), (2, 'e5'), (3, '.5%'), (4, '__'), (5, ' a'), (6, '-'), (7, '')) x(i, v))
SELECT id, term FROM k WHERE length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+(\\.[0-9]+)?%?$|^[0-9]+e[0-9]+$')
""".replace("\\\\", "\\"))
def keyword_noise(spark, folder):
    part = table(spark, folder, "part")
    forms = F.array(*[F.concat(F.col("p_size").cast("string"), F.lit(v)) for v in NOISE], F.col("p_name"))
    rows = part.select("p_partkey", F.posexplode(forms).alias("i", "term"))
    return rows.filter(T.valid_keyword(F.col("term"))).select((F.col("p_partkey") * 10 + F.col("i")).alias("id"), "term")


BM25 = rf"""
  n AS (SELECT doc_id, count(*) AS n_sents FROM sents GROUP BY ALL),
  w AS (SELECT doc_id, sent_no, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+')) AS term FROM sents),
  k AS (SELECT * FROM w WHERE term NOT IN ({ENGLISH_SQL})),
  f AS (SELECT doc_id, sent_no, term, count(*) AS tf FROM k GROUP BY ALL),
  z AS (SELECT doc_id, sent_no, sum(tf) AS len FROM f GROUP BY ALL),
  v AS (SELECT doc_id, sum(tf) AS total FROM f GROUP BY ALL),
  i AS (SELECT doc_id, term, ln(n_sents - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM f JOIN n USING (doc_id) GROUP BY doc_id, term, n_sents),
  e AS (SELECT doc_id, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY doc_id) ELSE raw END AS idf FROM i),
  m AS (SELECT f.doc_id, f.term, e.idf / n_sents * sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (total / n_sents)))) AS mass
        FROM f JOIN z USING (doc_id, sent_no) JOIN v USING (doc_id) JOIN n USING (doc_id) JOIN e USING (doc_id, term)
        GROUP BY f.doc_id, f.term, e.idf, n_sents),
  sc AS (SELECT s.doc_id, s.sent_no, s.sentence, coalesce(q.score, 0) AS score FROM sents s LEFT JOIN
          (SELECT f.doc_id, f.sent_no, sum(tf * mass) AS score FROM f JOIN m USING (doc_id, term) GROUP BY ALL) q
          USING (doc_id, sent_no))
"""


@check(f"""
WITH {SENTENCES.format(key="conv_id * 1000 + turn", src="conversations")}, {BM25}
SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, round(score, 6) AS score FROM sc
""")
def bm25_sentences(spark, folder):
    turns = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return excerpt.bm25_sentences(turns, "text", stop=list(STOPWORDS["en"])).withColumn("score", F.round("score", 6))


@check(f"""
WITH {SENTENCES.format(key="doc_id", src="documents")}, {BM25},
  r AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, sent_no DESC) <= 5)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_no) AS excerpt FROM r GROUP BY ALL
""")
def bm25_excerpt(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return excerpt.excerpt_bm25(docs, "text", 5, stop=list(STOPWORDS["en"]))


@check(rf"""
WITH a AS (SELECT page_id, {ARTICLE_HTML} AS body FROM pages),
  p AS (SELECT page_id, list_transform(regexp_extract_all(body, '(?s)<p>(.*?)(?:</p>|<br>)', 1),
          lambda x: replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&')) AS ps FROM a)
SELECT page_id, CASE WHEN len(ps) > 0 THEN CASE WHEN length(coalesce(nullif(ps[1], ''), ps[2])) > 60
  THEN coalesce(nullif(ps[1], ''), ps[2]) ELSE '' END END AS excerpt FROM p
""")
def first_paragraph_excerpt(spark, folder):
    pages = table(spark, folder, "pages")
    body = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    found = F.regexp_extract_all(body, F.lit("(?s)<p>(.*?)(?:</p>|<br>)"), F.lit(1))
    plain = F.transform(found, lambda x: F.replace(F.replace(
        F.regexp_replace(x, "<[^>]*>", ""), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    none = F.lit(None).cast("string")
    return pages.select("page_id", plain.alias("ps")).select(
        "page_id", choose_excerpt(none, none, F.col("ps")).alias("excerpt"))


CJK_FROM, CJK_TO = "aeiounrs", "的一是不了人在有"


@check(rf"""
WITH d AS (SELECT DISTINCT translate(term, '{CJK_FROM}', '{CJK_TO}') AS term FROM
    (SELECT unnest({DOC_TOKENS}) AS term FROM documents) WHERE length(term) BETWEEN 2 AND 6),
  p AS (SELECT '(' || string_agg(term, '|' ORDER BY length(term) DESC, term) || '|[一-龥]|(?:[^\P{{L}}一-龥]|[\p{{N}}_])+)' AS pattern, count(*) AS n FROM d),
  w AS (SELECT doc_id, n, regexp_extract_all(translate(lower(text), '{CJK_FROM}', '{CJK_TO}'), pattern) AS t FROM documents, p)
SELECT doc_id, n AS n_words, CAST(len(t) AS BIGINT) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM w
""")
def segment_cjk(spark, folder):
    """Whole texts, part of their letters written as CJK characters, cut by the corpus's own words of up to six letters."""
    documents = table(spark, folder, "documents")
    docs = documents.select("doc_id", F.translate(F.lower("text"), CJK_FROM, CJK_TO).alias("text"))
    words = scoring.tokenize(documents, "text", "doc_id").filter(F.length("term").between(2, 6))
    dictionary = words.select(F.translate("term", CJK_FROM, CJK_TO).alias("term")).distinct().cache()
    return segment.segment_cjk(docs, "text", dictionary).select(
        "doc_id", F.lit(dictionary.count()).alias("n_words"), F.size("terms").cast("bigint").alias("n_terms"),
        F.md5(F.array_join("terms", " ")).alias("digest"))


LETTERS = "abcdefghijklmnopqrstuvwxy"
GLYPHS = "".join(chr(0x4E00 + i) for i in range(25))


@check(f"""
WITH t AS (SELECT page_id, translate(lower({H1}), '{LETTERS}', '{GLYPHS}') AS title FROM pages),
  c AS (SELECT page_id, unnest(p) AS ch, generate_subscripts(p, 1) AS pos FROM
        (SELECT page_id, regexp_extract_all(title, '[一-龥]|[^一-龥]+') AS p FROM t))
SELECT page_id, string_agg(coalesce(lower(n_name), ch), '-' ORDER BY pos) AS syllables
FROM c LEFT JOIN nation ON ch = chr(19968 + n_nationkey) GROUP BY ALL
""")
def transliterate_titles(spark, folder):
    titles = page_fields(spark, folder).select("page_id", F.translate(F.lower("title"), LETTERS, GLYPHS).alias("title"))
    glyph = F.element_at(F.split(F.lit(GLYPHS), ""), F.col("n_nationkey") + 1)
    syllables = table(spark, folder, "nation").select(glyph.alias("ch"), F.lower("n_name").alias("syllable"))
    return segment.transliterate(titles, "title", syllables, "page_id")


@check(f"""
WITH n AS (SELECT chr(CAST(19968 + n_nationkey AS INTEGER)) AS ch, lower(n_name) AS syllable, n_nationkey AS k FROM nation),
  p AS (SELECT a.ch || b.ch AS ch, a.syllable || b.k AS syllable FROM n a JOIN n b ON b.k = (a.k * 7 + 3) % 25
        UNION ALL SELECT a.ch || b.ch || c.ch, a.syllable || b.k || c.k FROM n a JOIN n b ON b.k = (a.k * 7 + 3) % 25 JOIN n c ON c.k = (b.k * 5) % 25),
  t AS (SELECT page_id, translate(lower({H1}), '{LETTERS}', '{GLYPHS}') AS title FROM pages),
  c AS (SELECT page_id, unnest(w) AS ch, generate_subscripts(w, 1) AS pos FROM (SELECT page_id, regexp_extract_all(title,
        (SELECT string_agg(ch, '|' ORDER BY length(ch) DESC) FROM p) || '|[一-龥]|[^一-龥]+') AS w FROM t)),
  e AS (SELECT ch, syllable FROM n UNION ALL SELECT * FROM p)
SELECT page_id, string_agg(coalesce(syllable, ch), '-' ORDER BY pos) AS syllables FROM c LEFT JOIN e USING (ch) GROUP BY page_id
""")
def phrase_readings(spark, folder):
    """Entries of one, two and three characters that overlap: the longest at a place gives the reading."""
    titles = page_fields(spark, folder).select("page_id", F.translate(F.lower("title"), LETTERS, GLYPHS).alias("title"))
    nation = table(spark, folder, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    n = nation.select(F.col("n_nationkey").alias("k"), "name", F.element_at(F.split(F.lit(GLYPHS), ""), F.col("n_nationkey") + 1).alias("ch"))

    def following(rows, factor, plus):
        after = n.select(F.col("k").alias("last"), F.col("ch").alias("next"))
        met = rows.withColumn("last", (F.col("k") * factor + plus) % 25).join(F.broadcast(after), "last")  # 25 nations
        return met.select(F.col("last").alias("k"), F.concat("name", F.col("last").cast("string")).alias("name"), F.concat("ch", "next").alias("ch"))

    pairs = following(n, 7, 3)
    entries = n.unionByName(pairs).unionByName(following(pairs, 5, 0)).select("ch", F.col("name").alias("syllable"))
    return segment.transliterate(titles, "title", entries, "page_id")


@check(r"""
WITH turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations),
  t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) AS w FROM turns),
  n AS (SELECT count(*) AS n FROM embeddings),
  c AS (SELECT doc_id, unnest(w) AS term FROM t),
  cv AS (SELECT doc_id, term, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM c, n JOIN embeddings
         ON vec_id = (ascii(term) * 31 + ascii(term[-1:]) * 7 + length(term)) % n.n),
  dv AS (SELECT doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS dvec FROM turns, n JOIN embeddings ON vec_id = doc_id % n.n),
  s0 AS (SELECT cv.doc_id, term, vec, list_cosine_similarity(vec, dvec) AS score, NULL::DOUBLE AS near, NULL::INTEGER AS rank FROM cv JOIN dv USING (doc_id)),
  b1 AS (SELECT doc_id, term AS bt, vec AS bv FROM s0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) = 1),
  s1 AS (SELECT s0.doc_id, term, vec, score, list_cosine_similarity(vec, bv) AS near, CASE WHEN term = bt THEN 1 END AS rank FROM s0 JOIN b1 USING (doc_id)),
  b2 AS (SELECT doc_id, term AS bt, vec AS bv FROM s1 WHERE rank IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(0.5 * score - 0.5 * near, 9) DESC, term) = 1),
  s2 AS (SELECT s1.doc_id, term, vec, score, greatest(near, list_cosine_similarity(vec, bv)) AS near, coalesce(rank, CASE WHEN term = bt THEN 2 END) AS rank FROM s1 LEFT JOIN b2 USING (doc_id)),
  b3 AS (SELECT doc_id, term AS bt FROM s2 WHERE rank IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(0.5 * score - 0.5 * near, 9) DESC, term) = 1),
  s3 AS (SELECT s2.doc_id, term, score, coalesce(rank, CASE WHEN term = bt THEN 3 END) AS rank FROM s2 LEFT JOIN b3 USING (doc_id))
SELECT doc_id, term, round(score, 6) AS score, rank FROM s3 WHERE rank IS NOT NULL
""")
def keyphrases_mmr(spark, folder):
    turns = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    n = table(spark, folder, "embeddings").select(F.count("*")).scalar()
    terms = turns.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"), 4))).alias("term"))
    code = F.ascii("term") * 31 + F.ascii(F.substring("term", -1, 1)) * 7 + F.length("term")
    cands = terms.withColumn("vec_id", code % n).join(vectors, "vec_id").select("doc_id", "term", F.col("embedding").alias("vec"))
    docs = turns.select("doc_id", (F.col("doc_id") % n).alias("vec_id")).join(vectors, "vec_id").select(
        "doc_id", F.col("embedding").alias("vec"))
    return keyphrases.keyphrases_mmr(cands, docs, k=3).withColumn("score", F.round("score", 6))


TAG_FORMS = """
  t AS (SELECT doc_id, lang, {tok} AS w FROM documents),
  g AS (SELECT doc_id, w, CASE doc_id % 5
      WHEN 0 THEN w[1:3]
      WHEN 1 THEN [w[1] || '(' || w[2] || ')', '标签：' || w[3] || '!', '2024']
      WHEN 2 THEN ['标签：' || w[1], w[2]]
      WHEN 3 THEN [w[1] || ' ' || w[2]]
      ELSE [] END AS tags FROM t WHERE len(w) >= 3)
""".format(tok=DOC_TOKENS)
SPLIT = r"""
  s AS (SELECT doc_id, w, tags, CASE WHEN len(list_filter(tags, lambda x: contains(x, '('))) > 0 THEN
      list_transform(list_filter(flatten(list_transform(tags, lambda x: string_split_regex(x, '[()]'))), lambda x: x <> ''),
        lambda x: trim(regexp_replace(replace(x, '标签：', ''), '[^\p{L}\p{N}_\s]', '', 'g')))
      ELSE tags END AS own FROM g)
"""


def _tag_rows(spark, folder):
    w = F.col("w")
    forms = (
        F.when(F.col("doc_id") % 5 == 0, F.slice(w, 1, 3))
        .when(F.col("doc_id") % 5 == 1, F.array(
            F.concat(w[0], F.lit("("), w[1], F.lit(")")), F.concat(F.lit("标签："), w[2], F.lit("!")), F.lit("2024")))
        .when(F.col("doc_id") % 5 == 2, F.array(F.concat(F.lit("标签："), w[0]), w[1]))
        .when(F.col("doc_id") % 5 == 3, F.array(F.concat_ws(" ", w[0], w[1])))
        .otherwise(F.array().cast("array<string>"))
    )
    docs = table(spark, folder, "documents").select("doc_id", T.tokens(F.col("text")).alias("w")).filter("size(w) >= 3")
    return docs.withColumn("tags", forms)


@check(f"WITH {TAG_FORMS}, {SPLIT} SELECT doc_id, array_to_string(own, '|') AS tags FROM s")
def tags_cleanup(spark, folder):
    return _tag_rows(spark, folder).select("doc_id", F.array_join(T.split_tags(F.col("tags")), "|").alias("tags"))


@check(f"""
WITH {TAG_FORMS}, {SPLIT},
  k AS (SELECT doc_id, own, w[-3:] AS kw, doc_id % 7 = 0 AS extract FROM s),
  n AS (SELECT *, len(own) = 0 OR len(list_filter(own, lambda x: starts_with(x, '标签：') OR contains(x, ' '))) > 0 AS need FROM k)
SELECT doc_id, array_to_string(CASE WHEN extract THEN kw ELSE list_filter(CASE WHEN need THEN kw ELSE own END,
  lambda x: regexp_matches(x, '[一-龥a-zA-Z]')) END, '|') AS tags FROM n
""")
def tags_cascade(spark, folder):
    rows = _tag_rows(spark, folder)
    last = F.slice("w", -3, 3)
    none = F.array().cast("array<string>")
    return rows.select("doc_id", F.array_join(
        choose_tags(F.col("doc_id") % 7 == 0, F.col("tags"), none, last, F.lit(True)), "|").alias("tags"))


@check(f"""
SELECT page_id, {H1} AS title FROM pages WHERE NOT (contains({H1}, 'there') OR contains({H1}, ' de '))
""")
def blocklist_title(spark, folder):
    rows = page_fields(spark, folder).withColumn("blocked", F.array(F.lit("there"), F.lit(""), F.lit(" de ")))
    return filters.filter_titles(rows, "blocked").select("page_id", "title")


@check("""
SELECT doc_id, n_chars FROM documents WHERE NOT (contains(text, ' und ') OR contains(text, 'the the') OR contains(text, '###'))
""")
def blocklist_words(spark, folder):
    docs = table(spark, folder, "documents").withColumn("blocked", F.array(F.lit(" und "), F.lit("the the"), F.lit("###")))
    return filters.filter_words(docs, "text", "blocked").select("doc_id", "n_chars")


@check("""
SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))
""")
def blocklist_content(spark, folder):
    docs = table(spark, folder, "documents")
    phrases = table(spark, folder, "benchmark").select(F.col("text").alias("phrase"))
    return filters.drop_blocked(docs, "text", phrases).select("doc_id", "n_chars")


@check(f"""
WITH d AS (SELECT conv_id * 1000 + turn AS doc_id, {DOC_TOKENS} AS w FROM conversations),
  n AS (SELECT count(*) AS n FROM embeddings),
  t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM d),
  v AS (SELECT doc_id, i, term, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM t, n JOIN embeddings
        ON vec_id = (ascii(term) * 31 + ascii(term[-1:]) * 7 + length(term)) % n.n),
  p AS (SELECT doc_id, i, dim, unnest([1, 2]) AS n, term AS a, lead(term) OVER o AS b, x, lead(x) OVER o AS y FROM v WINDOW o AS (PARTITION BY doc_id, dim ORDER BY i)),
  g AS (SELECT doc_id, dim, CASE n WHEN 1 THEN a ELSE a || ' ' || b END AS term, any_value(CASE n WHEN 1 THEN x ELSE (x + y) / 2 END) AS x FROM p
        WHERE n = 1 OR b IS NOT NULL GROUP BY ALL),
  c AS (SELECT doc_id, term, list(x ORDER BY dim) AS vec FROM g GROUP BY ALL),
  m AS (SELECT doc_id, list(x ORDER BY dim) AS dvec FROM (SELECT doc_id, dim, avg(x) AS x FROM v GROUP BY ALL) GROUP BY doc_id),
  s AS (SELECT c.doc_id, term, vec, list_cosine_similarity(vec, dvec) AS score FROM c JOIN m USING (doc_id)),
  f AS (SELECT doc_id, term AS bt, vec AS bv FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) = 1),
  e AS (SELECT s.doc_id, term, score, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(0.5 * score - 0.5 * list_cosine_similarity(vec, bv), 9) DESC, term) AS r
        FROM s JOIN f USING (doc_id) WHERE term <> bt)
SELECT doc_id, bt AS term, 1 AS rank FROM f UNION ALL SELECT doc_id, term, 2 FROM e WHERE r = 1
""")
def phrase_vectors_mmr(spark, folder):
    """Phrases of one and two words, their vectors the means of their words', two for every turn."""
    turns = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), T.tokens(F.col("text")).alias("terms"))
    given = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    words = turns.select(F.explode("terms").alias("term")).distinct()
    place = (F.ascii("term") * 31 + F.ascii(F.substring("term", -1, 1)) * 7 + F.length("term")) % given.count()
    vectors = words.join(given, place == F.col("vec_id")).select("term", "vec")
    return phrases.phrase_scores(turns, vectors, "terms", k=2, longest=2).select("doc_id", "term", "rank")
