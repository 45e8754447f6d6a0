"""Partitioning documents into shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import ITERATIONS, assign, lloyd, mllib_assign, seeded_hash

#: Hex digits of the hash that deal rows of one ranking into buckets (16 ** 3 of them).
BUCKET_DIGITS = 3


def seeded_rank(rows: DataFrame, seed: int, within: str | None = None, key: str = "doc_id", out: str = "ord") -> DataFrame:
    """All columns and the rank from 0 in seeded hash order, over all rows or within a column's values.

    The hash is uniform, so its leading digits cut the ranking into even buckets: rows are numbered within
    buckets, and a bucket's offset comes from the counts of the buckets before it. No task ranks everything."""
    keys = [within] if within else []
    rows = rows.withColumn("__h", seeded_hash(seed, key)).withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    counts = rows.groupBy(*keys, "__b").count()
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias("__k") for k in keys], F.col("__b").alias("__b0"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__skip"))
    same = F.col("__b") == F.col("__b0")
    if within:
        same = same & F.col(within).eqNullSafe(F.col("__k"))
    number = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", key))
    # Without groups there are at most 16 ** BUCKET_DIGITS offsets.
    ranked = rows.withColumn("__n", number).join(offsets if within else F.broadcast(offsets), same)
    return ranked.withColumn(out, (F.col("__skip") + F.col("__n") - 1).cast("bigint")).drop("__h", "__b", "__n", "__b0", "__skip", "__k")


def random_shards(docs: DataFrame, num_shards: int = 32, seed: int = 42) -> DataFrame:
    """All columns and shard_id: round robin over a seeded shuffle, so sizes differ by one at most."""
    _positive(num_shards)
    return seeded_rank(docs, seed).withColumn("shard_id", F.col("ord") % num_shards)


def topic_shards(docs: DataFrame, num_shards: int = 32, seed: int = 42, iterations: int = ITERATIONS, method: str = "lloyd") -> DataFrame:
    """All columns and shard_id: one k-means cluster for each shard; an empty shard is an error."""
    _positive(num_shards)
    shards = _clustered(docs, num_shards, seed, iterations, method, "shard_id")
    return require_all_shards(shards, num_shards)


def heterogeneous_shards(docs: DataFrame, num_shards: int = 32, num_topics: int | None = None, seed: int = 42, iterations: int = ITERATIONS, topic_col: str | None = None, method: str = "lloyd") -> DataFrame:
    """All columns and shard_id: each topic is dealt over all shards, starting at its own.

    Topics are k-means clusters (as many as shards unless given), or a column that holds them already."""
    _positive(num_shards)
    if topic_col is None:
        docs = _clustered(docs, num_topics or num_shards, seed, iterations, method, "topic_id")
        topic_col = "topic_id"
    ranked = seeded_rank(docs, seed, within=topic_col)
    shards = ranked.withColumn("shard_id", ((F.col(topic_col) % num_shards + F.col("ord")) % num_shards).cast("bigint"))
    return require_all_shards(shards, num_shards)


def _clustered(docs: DataFrame, k: int, seed: int, iterations: int, method: str, out: str) -> DataFrame:
    if method == "mllib":
        return mllib_assign(docs, k, seed, out=out)
    if method != "lloyd":
        raise ValueError(f"unknown clustering method {method!r}")
    return assign(docs, lloyd(docs, k, seed, iterations), out)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"random": random_shards, "topic_based": topic_shards, "heterogeneous": heterogeneous_shards}


def build_shards(shard_type: str, docs: DataFrame, num_shards: int, seed: int = 42, **options) -> DataFrame:
    """Dispatch by name, whatever its case."""
    try:
        strategy = STRATEGIES[shard_type.lower()]
    except KeyError:
        raise ValueError(f"unknown shard type {shard_type!r}") from None
    return strategy(docs, num_shards, seed=seed, **options)


def _positive(num_shards: int) -> None:
    if num_shards <= 0:
        raise ValueError("the number of shards must be positive")


def require_all_shards(shards: DataFrame, num_shards: int) -> DataFrame:
    found = shards.select("shard_id").distinct().count()
    if found != num_shards:
        raise RuntimeError(f"{num_shards - found} of {num_shards} shards are empty")
    return shards


def doc_to_shard(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, shard_id), one row for each document; of repeated documents the largest shard id holds."""
    return shards.groupBy(key).agg(F.max("shard_id").alias("shard_id"))


def shard_sizes(shards: DataFrame, num_shards: int) -> DataFrame:
    """(shard_id, size) for every shard, empty ones included."""
    numbers = shards.sparkSession.range(num_shards).withColumnRenamed("id", "shard_id")
    counts = shards.groupBy("shard_id").agg(F.count("*").alias("size"))
    return numbers.join(counts, "shard_id", "left").select("shard_id", F.coalesce("size", F.lit(0)).alias("size"))


def shard_size_summary(shards: DataFrame, num_shards: int) -> DataFrame:
    return size_summary(shard_sizes(shards, num_shards), "num_shards")


def size_summary(sizes: DataFrame, count_name: str, size: Column | None = None) -> DataFrame:
    size = F.col("size") if size is None else size
    return sizes.agg(F.count("*").alias(count_name), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.avg(size).alias("mean_size"))
