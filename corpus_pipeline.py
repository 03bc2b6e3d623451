"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.

Defined cases, for every stage: extra columns are kept by all but the last, whatever their names; nulls in columns that a stage
doesn't read stay; very long texts are read whole; an empty table gives an empty one. Null and empty texts: language ID
drops them (they have no letters), all other stages keep them, and packing gives them the end token alone. Repeated rows: language ID,
decontamination, masking and packing treat each for itself; near-duplicate removal makes rows of one doc_id and text one.
Ties: of equally likely languages the first by name, of linked documents the one of the smallest doc_id stays; rows
without doc_id can't be told apart by links, and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, langid, packing, secrets, similarity
from larkspur.session import ensure_checkpoint_dir
from larkspur.sources.files import Folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones of docs teach; what the models reject, or has no letters, goes."""
    return langid.accepted(docs, langid.train(docs.select("text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more: that of the smallest doc_id."""
    return similarity.one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars set anew where they were."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared checkpoint folder and read again; what was read is deleted."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    files = Folder(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                files.delete(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs


#: Language models and the genetic packing aren't expressible in SQL; a test holds the stages against slow ones in plain Python.
ORACLE_SQL = None
