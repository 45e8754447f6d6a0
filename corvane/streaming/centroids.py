"""Shard centroids that follow a stream of document vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.vectors import mean_vectors, normalized


def streaming_centroids(docs: DataFrame, dim: int, key: str = "shard_id", column: str = "embedding") -> DataFrame:
    """(shard_id, centroid) over all rows seen so far, for output mode complete.

    State is a sum and a count for each shard and place, so it needs no watermark."""
    return normalized(mean_vectors(docs, [key], dim, column), "centroid")
