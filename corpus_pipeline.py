"""Corpus preparation: toxic texts, exact copies and near copies go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet in the shared folder and reads it again for the next
stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm.common import documents, shared_dir, written
from lorewell.llm.exact_dedup import without_exact_duplicates
from lorewell.llm.mixing import mixed
from lorewell.llm.near_dedup import without_near_duplicates
from lorewell.llm.packing import pack
from lorewell.llm.toxicity import without_toxic

#: SQL has no counterpart of the fitted model, the sampling or the packing; the tests compare run() with plain Python.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on labelled documents among docs, doesn't reject."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return without_exact_duplicates(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8 or more), the document with the smallest id."""
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: not at all, or up to three times."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = documents(spark, sf_dir), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
