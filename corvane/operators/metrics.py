"""What survives the selection of shards, and what it costs.

Per-query metrics come as one row for each query; means over queries are in plans.experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .ranking import docs_of_shards

METHODS = ("single_centroid", "multi_centroid", "group_single_centroid", "group_multi_centroid")


def positives(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id): distinct judgments above 0."""
    return qrels.where(F.col("rel") > 0).select("query_id", "doc_id").distinct()


def relevant_shards(qrels: DataFrame, doc_to_shard: DataFrame) -> DataFrame:
    """(query_id, shard_id): shards with a positive document; queries without one are absent."""
    return positives(qrels).join(doc_to_shard.select("doc_id", "shard_id"), "doc_id").select("query_id", "shard_id").distinct()


def evaluated_queries(queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id): embedded queries that have a relevant shard."""
    return queries.select("query_id").join(relevant.select("query_id").distinct(), "query_id", "left_semi")


def _hit_share(wanted: DataFrame, selected: DataFrame, key: str, out: str) -> DataFrame:
    chosen = selected.select("query_id", key).distinct().withColumn("hit", F.lit(1.0))
    return wanted.join(chosen, ["query_id", key], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias(out))


def shard_recall(selected: DataFrame, relevant: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, shard_recall): the share of relevant shards that are selected. Of queries given that have no
    relevant shard it is 0."""
    found = _hit_share(relevant, selected, "shard_id", "shard_recall")
    return found if queries is None else _zero_filled(queries, found, "shard_recall")


def _zero_filled(queries: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return queries.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce(name, F.lit(0.0)).alias(name))


def doc_coverage(selected: DataFrame, qrels: DataFrame, doc_to_shard: DataFrame, queries: DataFrame, count_unmapped: bool = False) -> DataFrame:
    """(query_id, doc_coverage): the share of positive documents whose shard is selected, among those that have a
    shard, or with count_unmapped among all; 0 where there is none."""
    wanted = positives(qrels).join(queries.select("query_id").distinct(), "query_id", "left_semi")
    placed = wanted.join(doc_to_shard.select("doc_id", "shard_id"), "doc_id", "left" if count_unmapped else "inner")
    return _zero_filled(queries, _hit_share(placed, selected, "shard_id", "doc_coverage"), "doc_coverage")


def doc_recall_at_k(queries: DataFrame, selected: DataFrame, qrels: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_recall): positives among the k best documents of the selected shards, over all positives.

    Candidates of a query are cut to k where they are scored (the ranking window keeps k rows of each task
    before its shuffle), so no query's candidates meet in one task."""
    if k <= 0:
        return queries.select("query_id").distinct().withColumn("doc_recall", F.lit(0.0))
    wanted = positives(qrels)
    chosen = selected.select("query_id", "shard_id").distinct().join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = docs_of_shards(shards.select("doc_id", "shard_id", "embedding"), chosen, "q").select("query_id", "doc_id", dot(F.col("q"), F.col("embedding")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    hits = best.select("query_id", "doc_id").withColumn("hit", F.lit(1.0))
    found = wanted.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("doc_recall"))
    return _zero_filled(queries, found, "doc_recall")


def group_recall(selected_groups: DataFrame, relevant: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, group_recall): the share of groups with a relevant shard that are selected."""
    wanted = relevant.join(groups, "shard_id").select("query_id", "group_id").distinct()
    return _hit_share(wanted, selected_groups, "group_id", "group_recall")


def group_drop_error(selected_groups: DataFrame, relevant: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, drop_error): whether groups are relevant and none of them is selected."""
    found = group_recall(selected_groups, relevant, groups)
    dropped = relevant.select("query_id").distinct().join(found, "query_id", "left")
    return dropped.select("query_id", F.coalesce(F.col("group_recall") == 0, F.lit(False)).alias("drop_error"))


def scoring_cost(method: str, num_shards: int, centroids_per_shard: int | None = None, num_groups: int | None = None, num_selected_groups: int | None = None, group_sizes: list[int] | None = None) -> int:
    """Centroid comparisons of one query; expected shards of the selected groups round half to even."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    multi, grouped = "multi" in method, method.startswith("group")
    if multi and centroids_per_shard is None:
        raise ValueError("centroids_per_shard is missing")
    each = centroids_per_shard if multi else 1
    if not grouped:
        return num_shards * each
    if num_groups is None or num_selected_groups is None or group_sizes is None:
        raise ValueError("num_groups, num_selected_groups and group_sizes are needed")
    sizes = [s for s in group_sizes if s]
    expected = round(sum(sizes) / len(sizes) * num_selected_groups) if sizes else 0
    return num_groups + expected * each


def actual_scoring_cost(centroids: DataFrame) -> DataFrame:
    """(actual_cost): the centroids that exist; small shards hold fewer than asked for."""
    return centroids.agg(F.count("*").alias("actual_cost"))
