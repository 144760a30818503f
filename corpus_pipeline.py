"""The training-data pipeline: stages over documents, each a thin call of one operator.

A stage's result is written as Parquet to the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, line_dedup, ngram_join, packing, quality
from tidemark.llm.common import read
from tidemark.llm.queries import tokenizer_path
from tidemark.session import stable, utc

#: No share of lost characters exempts a document: the n-gram stage decides on copies at its own threshold only.
COPY_FROM = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs, whole_from=COPY_FROM, keep_emptied=False)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The fitted network, edit distances and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(utc(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
