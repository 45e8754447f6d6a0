"""Retrieval collections on disk: corpus.jsonl, queries.jsonl and qrels/<split>.tsv."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"
QRELS = ("query-id", "corpus-id", "score")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path).select(F.col("_id").alias("doc_id"), "title", "text")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): a missing text is empty; of repeated ids the last in the file holds."""
    rows = spark.read.schema(QUERIES).json(path).select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    return rows.groupBy("query_id").agg(F.max_by("text", F.struct("f", "b", "n")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel). Every column is read as text, so ids such as 001 stay as they are; a header
    that lacks one of the three columns raises."""
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    lacking = [c for c in QRELS if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    return raw.select(F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("doc_id"), F.col("score").cast("int").alias("rel"))


def keep_last(qrels: DataFrame, order: str) -> DataFrame:
    """One judgment for each (query, document): the last by the order column."""
    newest = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(order))
    return qrels.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def read_collection(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgments; nothing is downloaded, a path that is not there raises."""
    root = root.rstrip("/")
    return read_corpus(spark, f"{root}/corpus.jsonl"), read_queries(spark, f"{root}/queries.jsonl"), read_qrels(spark, f"{root}/qrels/{split}.tsv")


def raw_profile(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes, lines) of every file below a raw collection; text lines, headers included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    lines = spark.read.option("recursiveFileLookup", True).text(root).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("lines"))
    return files.join(lines, "file", "left").select("file", "bytes", F.coalesce("lines", F.lit(0)).alias("lines"))
