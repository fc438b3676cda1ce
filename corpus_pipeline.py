"""A training corpus from raw documents in five stages, each written and read again."""

from pyspark.sql import DataFrame, SparkSession

from foliagrid.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from foliagrid.llm._scratch import Scratch


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the model's limit; the model is fitted on labelled ones of docs."""
    return toxicity.civil_documents(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of similar ones."""
    return ngram_join.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32 of every copy of every document."""
    return token_files.tokens(docs)


STAGES = [("toxicity", civil), ("ngram_join", distinct), ("decontaminate", unseen), ("mixing", mixed), ("token_files", tokenized)]

#: SQL has neither the classifier nor the token files; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's output is a table in the shared folder and the next one's input."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
