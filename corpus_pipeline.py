"""A corpus pipeline of the operators in corvane.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of docs:
toxic documents go, one document of each near-duplicate group stays, personal data is masked in the text,
sources are mixed to their target weights (a document appears as often as the mix takes it), and what
is left is encoded to token ids and decoded again.

Empty inputs give empty outputs of the same columns; nulls, repeated rows and extra columns follow the
operators' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, mixing, pii, simhash, toxicity
from corvane.llm.common import documents, labels
from corvane.runtime import scratch_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): ids as array<int>, and the digests of them (as
    little-endian unsigned 32-bit integers) and of the text that they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: A trained classifier and BPE are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
