"""Vector arithmetic on array<double> columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Raw inner product; null where either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(df: DataFrame, column: str) -> DataFrame:
    """The frame with one vector column normalised; the norm is computed once a row."""
    scaled = df.withColumn("__norm", norm(F.col(column)))
    scale = F.when(F.col("__norm") > 0, F.col("__norm")).otherwise(1.0)
    return scaled.withColumn(column, F.transform(column, lambda x: x / scale)).drop("__norm")


def all_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def dimension(df: DataFrame, column: str = "embedding") -> int:
    """Length of the vectors; 0 for an empty table."""
    row = df.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).first()
    return row.n if row else 0


def mean_vectors(df: DataFrame, keys: Sequence[str], dim: int, column: str = "embedding", out: str = "centroid") -> DataFrame:
    """One mean vector for each key: a sum for each place and one count, so rows are summed where they are read
    and never exploded by their places. Rows without a vector do not count."""
    sums = [F.sum(F.get(F.col(column), i)).alias(f"__s{i}") for i in range(dim)]
    means = df.groupBy(*keys).agg(F.count(column).alias("__n"), *sums)
    return means.select(*keys, F.array(*[F.col(f"__s{i}") / F.nullif(F.col("__n"), F.lit(0)) for i in range(dim)]).alias(out))
