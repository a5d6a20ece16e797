"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``.

1. toxicity: documents that the conditional random field rejects (score of 0.3 or more) go.
2. near_duplicates: one document of each group stays, the one of the least doc_id; 80 % of shared shingles link two.
3. decontamination: documents with any ten-word window of a benchmark item go.
4. secrets: every secret span is replaced by ``[secret]`` in text, and n_chars follows; no document goes.
5. packing: pieces of at most 2048 ids with their sequence and offset.

Null and empty texts pass all stages and are packed as their end id; repeated rows fall to one in stage 2; empty tables
give an empty result; further columns travel through stages 1 to 4 unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontaminate, near_dup, packing, secret_novelty, toxic_crf
from threadloom.llm.common import shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_crf.without_toxic(docs, toxic_crf.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_novelty.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(docs, packing.tokenizer_path()))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]
#: Toxicity, tokenising and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
