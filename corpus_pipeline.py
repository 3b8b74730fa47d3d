"""Corpus pipeline: quality rules, quality classifier, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; its rows are written to the shared
folder and read again.  Counted as part of the subpackage ``loomspark.llm``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import shared_folder, table
from loomspark.llm.packing import best_fit
from loomspark.llm.quality_classifier import apply_classifier
from loomspark.llm.quality_rules import apply_rules
from loomspark.llm.simhash import near_dedup
from loomspark.llm.substring import deduplicate


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule."""
    return apply_rules(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels`` and the documents at hand, takes for good."""
    return apply_classifier(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies."""
    return near_dedup(docs, k=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated passages of 35 words or more; n_chars follows the text."""
    return deduplicate(docs, width=35)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]
#: Stages learn, follow links and pack: SQL can't express them; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
