"""Corpus preparation in five stages, each by one operator of timegrid.llm.

Each stage takes all documents that the one before has kept and returns those that it keeps, with the same columns;
the last returns where each piece of a document lies in the packed sequences. Between stages the rows are a Parquet
table in the shared folder. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timegrid.llm.common import save
from timegrid.llm.language import identified_documents
from timegrid.llm.mixing import mixed_documents
from timegrid.llm.ngram_join import first_of_each
from timegrid.llm.packing import pack
from timegrid.llm.rules import accepted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay."""
    return identified_documents(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept stay; the rules learn from the table labels."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 of word 5-grams, that of the smallest id stays."""
    return first_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", packing),
]
#: Learned models, similarity classes and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
