"""Document texts, query ids and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doc_text(corpus: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, kept columns, text): title and text joined by a space, Unicode white space stripped from both ends."""
    joined = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return corpus.select("doc_id", *keep, F.regexp_replace(joined, r"(?U)^\s+|\s+$", "").alias("text"))


def query_texts(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))


def normalize_qrels(raw: DataFrame) -> DataFrame:
    """(query_id, doc_id, rel) with string ids and integer relevance, of any names in that order."""
    q, d, r = raw.columns[:3]
    return raw.select(F.col(q).cast("string").alias("query_id"), F.col(d).cast("string").alias("doc_id"), F.col(r).cast("int").alias("rel"))


def select_query_ids(qrels: DataFrame, positive_only: bool = False) -> DataFrame:
    """(query_id) of judged queries, numbers in numeric order and before other ids."""
    kept = qrels.where(F.col("rel") > 0) if positive_only else qrels
    return kept.select("query_id").distinct().orderBy(F.col("query_id").try_cast("bigint").asc_nulls_last(), "query_id")


def missing_query_texts(wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id) of wanted queries without a text row."""
    return wanted.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_anti")


def require_query_texts(wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """The wanted queries with their texts; raises with up to ten examples when one is missing."""
    missing = [r.query_id for r in missing_query_texts(wanted, queries).orderBy("query_id").limit(10).collect()]
    if missing:
        raise ValueError(f"queries without a text, for example {missing}")
    return query_texts(queries).join(wanted.select("query_id").distinct(), "query_id", "left_semi")
