"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, decontaminate, ngram_join, secrets, toxicity
from annalist.llm.common import read, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share this many hundredths of their shingles of so many words.
SHINGLE_WORDS, SHARE = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go. Learned from the labels of the documents at hand."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays; documents without words stay.

    Rows are told apart by id and text, so a repeated id keeps one row of a group; of equal rows one stays.
    """
    rows = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("text")).alias("key"))
    groups = ngram_join.join_components(rows, words=SHINGLE_WORDS, share=SHARE, id_col="key")
    firsts = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("kept")).agg(F.sum((F.col("n_shingles") > 0).cast("int")).alias("n"))
    kept = rows.join(firsts, F.col("key") == F.col("kept"))
    return kept.filter("n <= 1").select(COLUMNS).union(kept.filter("n > 1").dropDuplicates(["key"]).select(COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.with_hits(docs.select(COLUMNS), read(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask; all documents stay."""
    masked = secrets.redact(docs.select(COLUMNS), secrets.standard(spark))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lengths and digests of the ids of each document and of what they decode to."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("byte_bpe", tokenize),
]

#: The stages cannot be stated in SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each through a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
