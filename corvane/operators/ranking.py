"""Ranking shards for queries by raw inner products with centroids.

Queries meet centroids in a nested-loop join: centroids are the size of the run's parameters (shards x
centroids each), and are broadcast while they stay within BROADCAST_BYTES; beyond it, queries and centroids
are split into blocks that meet in a shuffle. Ties go to the lower group rank, then the lower id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dimension, dot

BROADCAST_BYTES = 64 << 20
#: Beyond that, a block of the other side holds about so many bytes.
BLOCK_BYTES = 16 << 20


def meet(queries: DataFrame, others: DataFrame, vector: str = "centroid") -> DataFrame:
    """Every query with every row of the other frame; the other one is broadcast if its checked size allows."""
    size = others.count() * max(1, dimension(others, vector)) * 8
    if size <= BROADCAST_BYTES:
        return queries.crossJoin(F.broadcast(others))
    # Queries come to each block of the other side; blocks grow in number with its bytes.
    blocks = -(-size // BLOCK_BYTES)
    left = queries.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("int"))))
    right = others.withColumn("__block", F.pmod(F.xxhash64(*[F.col(c) for c in others.columns if c != vector]), F.lit(blocks)).cast("int"))
    return left.join(right, "__block").drop("__block")


def docs_of_shards(shards: DataFrame, chosen: DataFrame, vector: str) -> DataFrame:
    """Documents joined by shard_id to (query, shard, vector) rows.

    There are only as many shard ids as shards, so documents are not shuffled by them: the chosen rows are
    broadcast if their checked size allows, and otherwise meet the documents in parts of each shard."""
    if chosen.count() * max(1, dimension(chosen, vector)) * 8 <= BROADCAST_BYTES:
        return shards.join(F.broadcast(chosen), "shard_id")
    # As many parts of each shard as there are tasks after a shuffle.
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = shards.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    right = chosen.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, ["shard_id", "__part"]).drop("__part")


def dot_scores(queries: DataFrame, others: DataFrame, vector: str = "centroid", query_vector: str = "embedding") -> DataFrame:
    """All columns but the vectors, and score."""
    return meet(queries, others, vector).withColumn("score", dot(F.col(query_vector), F.col(vector))).drop(query_vector, vector)


def _ranked(scores: DataFrame, *ties: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(order))


def rank_single(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, shard_id, score, rank) for every shard."""
    scores = dot_scores(queries.select("query_id", "embedding"), centroids.select("shard_id", "centroid"))
    return _ranked(scores, "shard_id").select("query_id", "shard_id", "score", "rank")


def shard_scores(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, shard_id, score): the best of each shard's centroids."""
    scores = dot_scores(queries.select("query_id", "embedding"), centroids.select("shard_id", "centroid_id", "centroid"))
    return scores.groupBy("query_id", "shard_id").agg(F.max("score").alias("score"))


def rank_multi(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    return _ranked(shard_scores(queries, centroids), "shard_id").select("query_id", "shard_id", "score", "rank")


def rank_groups(queries: DataFrame, group_centroids: DataFrame) -> DataFrame:
    """(query_id, group_id, score, rank)."""
    scores = dot_scores(queries.select("query_id", "embedding"), group_centroids.select("group_id", "centroid"))
    return _ranked(scores, "group_id").select("query_id", "group_id", "score", "rank")


def selected_groups(queries: DataFrame, group_centroids: DataFrame, num_selected: int) -> DataFrame:
    """(query_id, group_id, group_rank) of the first groups of each query."""
    ranked = rank_groups(queries, group_centroids).where(F.col("rank") <= num_selected)
    return ranked.select("query_id", "group_id", F.col("rank").alias("group_rank"))


def rank_group_single(queries: DataFrame, group_centroids: DataFrame, groups: DataFrame, centroids: DataFrame, num_selected: int = 1) -> DataFrame:
    """As rank_single, over the shards of the first groups only; carries group_rank."""
    chosen = selected_groups(queries, group_centroids, num_selected).join(groups, "group_id").join(centroids, "shard_id")
    scores = chosen.join(queries.select("query_id", "embedding"), "query_id").withColumn("score", dot(F.col("embedding"), F.col("centroid")))
    return _ranked(scores, "group_rank", "shard_id").select("query_id", "group_id", "group_rank", "shard_id", "score", "rank")


def rank_group_multi(queries: DataFrame, group_centroids: DataFrame, groups: DataFrame, centroids: DataFrame, num_selected: int = 1) -> DataFrame:
    """As rank_multi, over the shards of the first groups only; carries group_rank."""
    chosen = selected_groups(queries, group_centroids, num_selected).join(groups, "group_id").join(centroids, "shard_id")
    scores = chosen.join(queries.select("query_id", "embedding"), "query_id").withColumn("score", dot(F.col("embedding"), F.col("centroid")))
    best = scores.groupBy("query_id", "group_id", "group_rank", "shard_id").agg(F.max("score").alias("score"))
    return _ranked(best, "group_rank", "shard_id").select("query_id", "group_id", "group_rank", "shard_id", "score", "rank")


def top_b(ranking: DataFrame, b: int) -> DataFrame:
    """The first b shards of each query, or fewer where there are fewer."""
    return ranking.where(F.col("rank") <= b)
