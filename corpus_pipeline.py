"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept:
quality rules drop documents, near-duplicate groups shrink to one, secrets are
blanked, sources are mixed in training order (documents repeat as their source's
target asks), and what is left is encoded. All but the last return the columns of
``documents``. Tokenizer checks and encoding can't be said in SQL, so the pipeline
is tested against a brute-force version.

Edge cases: null and empty texts fail the quality rules; a null lang is judged by its
script, a null source is a source of its own; rows without a doc_id are kept, one per
text, and repeated rows of one doc_id become one; very long texts are handled whole;
extra columns, whatever their names, pass through all stages but the last; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import mixing, pieces, quality, secrets, simhash
from sparkloom.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digest(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again.

    A stage's folder goes once the stage behind it has been written; the last one stays,
    since the result is read from it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
