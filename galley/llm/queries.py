"""Registered queries of the corpus operators and the SQL that must agree with them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from galley.llm import bloom_search, bpe, chat, cotraining, decontaminate, jaccard_join, line_dedup, maxscore, merkle, secrets, simhash, token_files, warc
from galley.llm.common import table, whole_text

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


SHOWN = r"length(regexp_replace(replace({0}, '\', '\\'), '([<\[])', '\1\\', 'g'))"


@query(rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  s AS (SELECT *, sum({SHOWN.format("role")} + {SHOWN.format("text")} + 23)
          OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS n,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id
""")
def op1_prefix_targets(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    examples = chat.prefix_targets(turns.unionByName(extra))
    loss = chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end"))
    whole = examples.select("conv_id", "n_turns", "text", loss.alias("loss")).groupBy("conv_id").agg(
        chat.read_turns(F.max_by("text", "n_turns")).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_turns", "loss"))), lambda e: e["loss"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
        FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM s
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 20
""")
def op2_maxscore_top_k(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return maxscore.top_k(vectors, F.col("id") % 20 == 0, 20)


@query()
def op3_secret_spans(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.samples(docs))).select("doc_id", "base", "spans")
    counts = [secrets.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


@query()
def op4_simhash_near_duplicates(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op5_simple8b_token_files(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    tokens = token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.select("doc_id", "start", F.size("ids").cast("bigint").alias("n_tokens"),
                         token_files.crc32_of_ids(F.col("ids")).alias("ids_crc32"))


@query()
def op6_zstd_warc(spark, folder):
    found = warc.archive(table(spark, folder, "pages").select("page_id", "url", "html"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op7_line_hash_dedup(spark, folder):
    return line_dedup.repeats(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op8_bpe_round_trip(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op9_benchmark_decontamination(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


@query()
def op10_cotraining_quality(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = cotraining.features(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    model = cotraining.fit(found, labels)
    return cotraining.score(found, model).select("doc_id", "text_score", "meta_score", "score", "keep")


SHINGLES = r"""w AS (SELECT row_number() OVER () AS row, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT row, doc_id, list_distinct(list_transform(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 2, 2) END),
      lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w)"""


@query(rf"""
WITH RECURSIVE {SHINGLES},
  u AS (SELECT list_sort(s) AS k, min(row) AS u FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
  x AS (SELECT u, len(k) AS n, unnest(k) AS h FROM u),
  p AS (SELECT a.u AS a, b.u AS b FROM x a JOIN x b ON a.h = b.h AND a.u < b.u GROUP BY a.u, b.u, a.n, b.n
        HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT u, u FROM u),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
  root AS (SELECT a AS u, min(b) AS root FROM r GROUP BY a),
  d AS (SELECT s.doc_id, len(s.s) AS n, root.root FROM s LEFT JOIN u ON u.k = list_sort(s.s) LEFT JOIN root ON root.u = u.u)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id FROM d
""")
def op11_ngram_jaccard_join(spark, folder):
    return jaccard_join.components(table(spark, folder, "documents").select("doc_id", "text"))


TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS w FROM documents),
  i AS (SELECT row_number() OVER () AS item, item_id, unnest({TERMS}) AS term FROM benchmark),
  c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
  t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
  q AS (SELECT item, item_id, term, count(*) AS times FROM i GROUP BY ALL),
  w AS (SELECT item, item_id, term, times * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), c),
  s AS (SELECT item, item_id, row, doc_id,
      CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
    FROM w JOIN t USING (term), c GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
""")
def op12_bloom_ranked_search(spark, folder):
    return bloom_search.search(table(spark, folder, "benchmark"), table(spark, folder, "documents").select("doc_id", "text"))


ASCII_CASE = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
                     for c in ("doc_id", "source", "lang", "n_chars", "{0}"))
CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, c)), 4294967295), 4294967295)"""
TREE = """{0} AS (SELECT {1}, 0 AS level, pos, n, h FROM {2}
    UNION ALL SELECT {1}, level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
      FROM {0} WHERE n > 1 GROUP BY {1}, level, pos // 16),
  {0}_siblings AS (SELECT *, coalesce(string_agg(h, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {0} WINDOW o AS (PARTITION BY {1}, level, pos // 16 ORDER BY pos)),
  {0}_fold AS (SELECT row, {1}, 0 AS level, pos, x, proof FROM {3}
    UNION ALL SELECT f.row, f.{1}, f.level + 1, f.pos // 16, sha256(s.l || f.x || s.r), f.proof || s.l || s.r
      FROM {0}_fold f JOIN {0}_siblings s ON s.{1} = f.{1} AND s.level = f.level AND s.pos = f.pos WHERE s.n > 1),
  {0}_ends AS (SELECT f.* FROM {0}_fold f JOIN {0} t ON t.{1} = f.{1} AND t.level = f.level AND t.pos = f.pos WHERE t.n = 1)"""


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({FIELDS.format("text")}) AS h,
    CASE WHEN {CRC} % 5 = 0 THEN sha256({FIELDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS other
  FROM documents),
  leaves AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS n, coalesce(other, h) AS x, '' AS proof FROM d),
  {TREE.format("low", "g", "leaves", "leaves")},
  subs AS (SELECT g, h, 0 AS one, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
  met AS (SELECT f.row, s.one, s.pos, f.x, f.proof FROM low_ends f JOIN subs s ON s.g = f.g),
  {TREE.format("top", "one", "subs", "met")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.x AS folded_root, e.x = r.h AS verified
FROM leaves l JOIN subs s ON s.g = l.g JOIN top_ends e ON e.row = l.row JOIN top r ON r.n = 1
""")
def op13_merkle_manifest(spark, folder):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(table(spark, folder, "documents"), tampered, text=F.translate("text", *ASCII_CASE))
