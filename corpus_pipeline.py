"""The training-data pipeline: five stages over the documents table.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dutyweave.llm import exact_dedup, language_id, mixing, ngram_join, piece_sampling
from dutyweave.staging import stage

#: Its network and sampled segmentations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the network was taught go: null texts, texts without letters, garbled and foreign ones."""
    return language_id.keep_identified(docs, language_id.fit(docs, reject=True))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights; a document comes once for each whole copy taken, and cut where a part of it is taken."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of every document, checked to decode to its text."""
    return piece_sampling.encode(docs, piece_sampling.load_vocabulary())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_duplicates),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
