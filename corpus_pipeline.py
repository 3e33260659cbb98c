"""A training corpus from raw documents, in five stages, each written as Parquet and reread by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, line_dedup, ngram_join, packing, quality
from quillon.llm._text import shared_checkpoints

#: the stages have no common SQL form: classifiers, suffix ranks, set joins and tokenisers are tested in tests/llm
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier rejects (score below 0.3).

    Whole texts are scored; null texts count as empty; repeated rows go or stay alike; an empty table
    stays empty; columns of any name are kept.
    """
    return quality.kept(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs of 50 words or more; documents left without words by that go.

    The first copy by (doc_id, text hash, line) stays. Null and empty texts stay as they are, rows of
    one doc_id and one text are one document and stay alike; columns of any name are kept.
    """
    return line_dedup.line_dedup(docs, drop_emptied=True, counted=None)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near copies: five-word shingles, Jaccard 0.8 or more.

    The smallest doc_id stays, one row of repeated rows, and every text of a repeated doc_id that is
    in no group with another. Documents without words are in no group. Columns of any name are kept.
    """
    return ngram_join.one_of_each(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item; null and empty texts and rows without doc_id stay, repeated rows go or stay alike."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens; null texts are empty, repeated rows are packed as often as they stand."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; what lies between them is written to the shared checkpoint folder."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
