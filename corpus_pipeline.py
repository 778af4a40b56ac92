"""Corpus preparation: quality, near copies, benchmark leaks, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import bpe, cotraining, decontaminate, near_sets, secrets
from galley.llm.common import DOCUMENTS, stored, table, whole_text


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the co-trained classifier rejects."""
    model = cotraining.fit(cotraining.features(docs), table(spark, sf_dir, "labels"))
    return cotraining.score(cotraining.views(docs), model).filter("keep").select(*DOCUMENTS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of least id, of each group of near copies, linked by five-word similarity of at least 0.8."""
    return near_sets.one_of_each(docs.select(*DOCUMENTS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    leaked = decontaminate.is_leaked(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.filter(~leaked).select(*DOCUMENTS)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in every text; documents without any keep theirs, and all stay."""
    found = secrets.scan(docs.select(*DOCUMENTS), secrets.train(secrets.samples(docs)))
    masked = secrets.redact(whole_text(), secrets.merged(F.col("spans")))
    return found.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))).select(*DOCUMENTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark_leaks),
          ("secret scans", secret_spans), ("BPE encoding", tokens)]

#: Fitted classifiers and sketches cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
