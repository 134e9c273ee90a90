"""Corpus pipeline: the stages that turn raw documents into clean, deduplicated, tokenised ones.

Every stage calls one operator of ``parlance.llm`` on all documents that the
stage before it kept, with the parameters of that operator's query.  The first
four give documents with the columns they came with; the last adds the ids.
Documents without text fail the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontam, quality, simhash, sp_codec, toxicity
from parlance.llm.common import bounded_batches, read_documents
from parlance.session import fresh_path

PIECES = "piece_bpe_32k.model"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (learned on this table's labels) scores below 0.5."""
    return toxicity.kept_documents(docs, read_documents(spark, sf_dir, "labels"))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the least doc_id."""
    return simhash.deduplicated(docs, width=3, radius=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edits allowed for."""
    return decontam.clean_documents(docs, read_documents(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids (``ids``) and whether these decode to the text (``round_trip``)."""
    bounded_batches(spark)
    return sp_codec.encoded_and_checked(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifier, the fingerprints and the codec cannot be written in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
