"""Checks of embeddings and judgments: one aggregate for each table, set differences as anti-joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import all_finite, norm
from .metrics import positives
from .ranking import dot_scores


def duplicate_ids(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(name, rows, distinct_ids, duplicates)."""
    per_id = rows.groupBy(key).count()
    return per_id.agg(F.lit(name).alias("name"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_ids")).withColumn("duplicates", F.col("rows") - F.col("distinct_ids"))


def norm_summary(rows: DataFrame, name: str, expected_norm: float = 1.0, tolerance: float = 1e-3, sample: int | None = None) -> DataFrame:
    """(name, checked, not_finite, min_norm, mean_norm, max_norm, finite, norms_ok) over all rows, or over so
    many evenly spaced positions. An empty table is not finite; norms never fail a run, they warn."""
    if sample is not None:
        n = rows.count()
        if n > sample:
            rows = rows.where(F.floor((F.col("pos") + 1) * F.lit(sample) / n) > F.floor(F.col("pos") * F.lit(sample) / n))
    checked = rows.select(norm(F.col("embedding")).alias("norm"), F.coalesce(all_finite(F.col("embedding")), F.lit(False)).alias("finite"))
    out = checked.agg(F.lit(name).alias("name"), F.count("*").alias("checked"), F.count_if(~F.col("finite")).alias("not_finite"), F.min("norm").alias("min_norm"), F.avg("norm").alias("mean_norm"), F.max("norm").alias("max_norm"))
    near = lambda c: F.abs(F.col(c) - expected_norm) <= tolerance
    return out.withColumns({"finite": (F.col("checked") > 0) & (F.col("not_finite") == 0), "norms_ok": F.coalesce(near("min_norm") & near("mean_norm") & near("max_norm"), F.lit(False))})


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Single-row frames side by side."""
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    return out


def dataset_coverage(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, embedded: DataFrame, require_all_queries: bool = True) -> DataFrame:
    """One row of what lacks what, between texts, judgments and embeddings, and ok: nothing is missing (texts
    of unembedded queries may be, unless require_all_queries)."""
    doc_ids, query_ids = docs.select("doc_id").distinct(), embedded.select("query_id").distinct()
    wanted = positives(qrels)
    found = wanted.join(doc_ids.withColumn("there", F.lit(1)), "doc_id", "left")
    per_query = found.groupBy("query_id").agg(F.count("*").alias("n"), F.count("there").alias("found"))
    judged = qrels.select("query_id").distinct()
    row = _one_row([
        _count(corpus.select("doc_id").distinct().join(doc_ids, "doc_id", "left_anti"), "docs_without_embedding"),
        _count(doc_ids.join(corpus.select("doc_id"), "doc_id", "left_anti"), "embeddings_without_doc"),
        _count(queries.select("query_id").distinct().join(query_ids, "query_id", "left_anti"), "queries_without_embedding"),
        _count(query_ids.join(queries.select("query_id"), "query_id", "left_anti"), "embeddings_without_query"),
        _count(judged.join(query_ids, "query_id", "left_anti"), "judged_without_embedding"),
        judged.agg(F.count("*").alias("judged_queries")),
        per_query.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("positives"), F.coalesce(F.sum("found"), F.lit(0)).alias("found_positives"), F.count_if(F.col("found") == 0).alias("queries_all_missing")),
    ])
    row = row.withColumns({
        "missing_positives": F.col("positives") - F.col("found_positives"),
        "coverage": F.when(F.col("positives") > 0, F.col("found_positives") / F.col("positives")).otherwise(0.0),
        "positives_per_judged_query": F.when(F.col("judged_queries") > 0, F.col("positives") / F.col("judged_queries")).otherwise(0.0),
    })
    nothing = ["docs_without_embedding", "embeddings_without_doc", "judged_without_embedding", "missing_positives", *(["queries_without_embedding"] if require_all_queries else [])]
    ok = F.lit(True)
    for name in nothing:
        ok = ok & (F.col(name) == 0)
    return row.withColumn("ok", ok)


def topk_hit_rate(docs: DataFrame, queries: DataFrame, qrels: DataFrame, num_queries: int = 20, top_k: int = 10) -> DataFrame:
    """(queries, hits, hit_rate): of the first queries by id that have an embedded positive, how many find one
    among their top_k documents of the whole table."""
    wanted = positives(qrels).join(docs.select("doc_id"), "doc_id", "left_semi")
    able = queries.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    first = able.orderBy(F.col("query_id").try_cast("bigint").asc_nulls_last(), "query_id").limit(num_queries)
    # num_queries query vectors meet every document; each task keeps top_k rows of a query.
    scores = dot_scores(docs.select("doc_id", "embedding"), first.select("query_id", F.col("embedding").alias("centroid")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    hits = best.join(wanted, ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
    row = _one_row([_count(first, "queries"), _count(hits, "hits")])
    return row.withColumn("hit_rate", F.when(F.col("queries") > 0, F.col("hits") / F.col("queries")).otherwise(0.0))


def qrels_profile(qrels: DataFrame) -> DataFrame:
    """One row of counts over raw judgments; raw_lines includes the header line of the file they come from."""
    good = F.col("rel") > 0
    return qrels.agg(
        F.count("*").alias("rows"),
        (F.count("*") + 1).alias("raw_lines"),
        F.countDistinct("query_id").alias("queries"),
        F.countDistinct(F.when(good, F.col("query_id"))).alias("positive_queries"),
        F.count_if(good).alias("positive_rows"),
        F.countDistinct(F.when(good, F.col("doc_id"))).alias("positive_docs"),
    )


def missing_positive_docs(qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id) of positives without an embedding."""
    return positives(qrels).select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


def qrels_coverage(qrels: DataFrame, docs: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: judgments against embeddings; ok when no positive document or query is missing."""
    wanted = positives(qrels)
    asked = wanted.select("query_id").distinct()
    row = _one_row([
        qrels_profile(qrels).drop("raw_lines"),
        _count(missing_positive_docs(qrels, docs), "missing_positive_docs"),
        _count(asked.join(embedded.select("query_id"), "query_id", "left_anti"), "missing_positive_queries"),
        _count(embedded.select("query_id").distinct().join(qrels.select("query_id"), "query_id", "left_anti"), "extra_queries"),
    ])
    per = F.when(F.col("positive_queries") > 0, F.col("positive_rows") / F.col("positive_queries")).otherwise(0.0)
    return row.withColumn("positives_per_positive_query", per).withColumn("ok", (F.col("missing_positive_docs") == 0) & (F.col("missing_positive_queries") == 0))


def dataset_summary(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return _one_row([_count(corpus, "docs"), _count(queries, "queries"), _count(qrels.select("query_id").distinct(), "judged_queries")])


#: Names of powers of 1,024 bytes.
UNITS = ("B", "KB", "MB", "GB", "TB")


def byte_label(n: float) -> str:
    """A number of bytes in the largest unit of which there is at least one."""
    power = min(len(UNITS) - 1, int(math.log(abs(n), 1024) + 1e-12)) if abs(n) >= 1 else 0
    return f"{n / 1024**power:.2f} {UNITS[power]}"


#: What a build's metadata should tell, and the type of each.
METADATA = {"chunks": list, "num_docs": int, "chunk_size": int, "num_queries": int, "query_dim": int, "model": str, "split": str, "complete": bool}


def metadata_check(spark: SparkSession, metadata: dict, docs: DataFrame, embedded: DataFrame) -> DataFrame:
    """(key, value, state): what the metadata of a build says, and whether the tables bear it out: ok, missing, wrong type,
    or differs. Only differing numbers speak against the tables."""
    seen = {"num_docs": docs.count(), "num_queries": embedded.count()}
    rows = []
    for key, kind in METADATA.items():
        value = metadata.get(key)
        state = "missing" if value is None else "wrong type" if not isinstance(value, kind) else "differs" if seen.get(key, value) != value else "ok"
        rows.append((key, None if value is None else f"{len(value)} chunks" if isinstance(value, list) else str(value), state))
    return spark.createDataFrame(rows, "key string, value string, state string")
