"""Inputs of the queries, derived from the driver's tables by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, embedding, topic)."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("bigint").alias("topic"))


def query_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, embedding): every 25th vector."""
    return doc_embeddings(spark, sf_dir).where("pos % 25 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, rel): documents of the query's label by a modular rule, and edge cases."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = rows.where("vec_id % 25 = 0 and vec_id not in (50, 75)").select(F.col("vec_id").alias("qp"), "label")
    pairs = q.join(rows.withColumnRenamed("vec_id", "dp"), "label").where("qp <> dp").withColumn("m", (F.col("dp") * 31 + F.col("qp") * 17) % 5).where("m <= 2")
    graded = pairs.select(F.col("qp").cast("string").alias("query_id"), F.col("dp").cast("string").alias("doc_id"), F.when(F.col("qp") == 25, 0).otherwise(F.col("m")).cast("int").alias("rel"))
    missing = rows.where("vec_id % 100 = 0 or vec_id = 50").select(F.col("vec_id").cast("string").alias("query_id"), F.concat(F.lit("missing-"), F.col("vec_id").cast("string")).alias("doc_id"), F.lit(1).alias("rel"))
    strange = spark.createDataFrame([("999999", "1", 1)], "query_id string, doc_id string, rel int")
    return graded.unionByName(missing).unionByName(strange)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text")


def query_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): first user turns of conversations."""
    return table(spark, sf_dir, "conversations").where("turn = 0 and role = 'user'").select(F.col("conv_id").cast("string").alias("query_id"), "text")


def raw_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, rel) from quality labels."""
    rows = table(spark, sf_dir, "labels")
    return rows.select((F.col("doc_id") % 10).cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int").alias("rel"))
