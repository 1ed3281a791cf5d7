"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, sources are mixed, and what is left is packed.

Each stage is written as Parquet and read again as the next one's documents, so a lost executor costs one stage's work at
most. All but the last return the columns of documents; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm.common import scratch_path, table
from mnemospark.llm.op1_mix import mixed_documents
from mnemospark.llm.op5_toxicity import fit_chain, without_toxic
from mnemospark.llm.op7_superminhash import one_of_each
from mnemospark.llm.op10_pack import pack


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit_chain(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: The stages need a tokenizer and fitted models, which SQL has not; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
