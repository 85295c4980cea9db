"""From raw documents to an encoded training mix, in five stages over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txsieve.llm import bpe, jaccard_join, mixing, quality_classifier, toxicity
from txsieve.llm.common import cut, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, learned from the labels of these documents, rejects."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.keep_good(docs, quality_classifier.learned(docs, labels))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity network, learned from the labels of these documents, rejects."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.learned(docs, labels))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates: five-word n-grams, a Jaccard likeness of 0.8 or more."""
    return jaccard_join.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins out documents so that each source comes near its target share of words."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: its token count and the digests of both, a row for each copy."""
    return bpe.code_digests(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("toxicity", clean_documents),
    ("near duplicates", distinct_documents),
    ("mixing", mixed_documents),
    ("encoding", encoded_documents),
]

#: SQL can't express the models, the joins and the encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept, written and read again, from the table of documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
