"""A corpus pipeline: toxicity, exact duplicates, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of documents (packing: pieces); run()
writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import decontaminate, exact_dedup, minhash_dedup, packing, toxicity
from vigil.llm._common import small_batches, stage, table
from vigil.llm.queries import tokenizer_path

#: Documents that score as much are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score("text", net) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [(name, small_batches(f)) for name, f in [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]]

#: The trained network, the links and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
