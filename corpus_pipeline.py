"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's docs, which `run` writes
as Parquet under spark.checkpoint.dir and reads again. All but the last return the columns of documents. When a stage is
written, what it read is deleted; the last stage's rows stay.

Defined results, for every stage: a null or empty text has no words and fails the quality rules; rows with one doc_id are one
document for the classifier's and the near-dedup's verdicts, and documents of their own elsewhere; a null doc_id is
kept by both; null sources are one source, null languages are compared with all documents; without labels the classifier
keeps everything; columns beside those of documents are carried along under any name; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tactigrid.llm import empirical_bayes, minhash, mixing, packing, quality_rules
from tactigrid.llm.common import read_table, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go."""
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's posterior reject go."""
    return empirical_bayes.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    return minhash.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's text becomes the words that the mix takes of it; documents of which it takes none go."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("quality_classifier", classifier), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: The regression, the draws and the tokeniser can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return docs
