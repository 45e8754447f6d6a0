"""Shards as one or several normalised centroids, and groups of shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dimension, mean_vectors, normalized
from ..runtime import reliable_checkpoint
from .clustering import CENTRE_BYTES, ITERATIONS, assign, grouped_lloyd_all, lloyd, lloyd_local, seeded_hash
from .sharding import size_summary


def single_centroids(shards: DataFrame, column: str = "embedding") -> DataFrame:
    """(shard_id, centroid): the normalised mean of each shard's vectors."""
    return normalized(mean_vectors(shards, ["shard_id"], dimension(shards, column), column), "centroid")


def multi_centroids(shards: DataFrame, k: int = 4, seed: int = 42, iterations: int = 3, column: str = "embedding") -> DataFrame:
    """(shard_id, centroid_id, centroid): at most k normalised k-means centres of each shard."""
    return multi_centroids_all(shards, (k,), seed, iterations, column).drop("k")


def multi_centroids_all(shards: DataFrame, ks: tuple[int, ...], seed: int = 42, iterations: int = 3, column: str = "embedding") -> DataFrame:
    """(k, shard_id, centroid_id, centroid): multi_centroids for several k in the same passes over the documents."""
    return normalized(grouped_lloyd_all(shards, "shard_id", ks, seed, iterations, column=column), "centroid")


def shard_groups(centroids: DataFrame, num_groups: int = 4, seed: int = 42, iterations: int = ITERATIONS) -> DataFrame:
    """(shard_id, group_id): k-means over the shards' single centroids."""
    if num_groups <= 0:
        raise ValueError("the number of groups must be positive")
    # A row for each shard: written once, so that the steps do not go back to the documents.
    centroids = reliable_checkpoint(centroids.select("shard_id", "centroid"))
    found = centroids.count()
    if num_groups > found:
        raise ValueError(f"{num_groups} groups of {found} shards")
    # Shards whose centroids fit on the driver are compared there, by the same steps and formula.
    if found * max(1, dimension(centroids, "centroid")) * 8 > CENTRE_BYTES:
        return assign(centroids, lloyd(centroids, num_groups, seed, iterations, key="shard_id", column="centroid"), "group_id", "centroid").select("shard_id", "group_id")
    table = centroids.orderBy(seeded_hash(seed, "shard_id"), "shard_id").collect()
    near = lloyd_local(np.array([r.centroid for r in table]), num_groups, iterations)
    rows = [(r.shard_id, int(g)) for r, g in zip(table, near)]
    return centroids.sparkSession.createDataFrame(rows, f"shard_id {centroids.schema['shard_id'].dataType.simpleString()}, group_id bigint")


def group_centroids(centroids: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, centroid): the normalised mean of the member shards' centroids, whatever their sizes."""
    members = centroids.join(groups, "shard_id")
    return normalized(mean_vectors(members, ["group_id"], dimension(centroids, "centroid"), "centroid"), "centroid")


def group_size_summary(groups: DataFrame) -> DataFrame:
    """Of groups that have shards."""
    return size_summary(groups.groupBy("group_id").agg(F.count("*").alias("size")), "num_groups")
