"""k-means with fixed starts: Lloyd steps whose centres (k x dim numbers) are all the driver sees.

This is an algorithmic substitute for seeded mini-batch k-means: starts are the first k rows in a seeded
hash order, steps are full passes, ties go to the lowest centre. mllib_assign offers MLlib's k-means.

Centres go to the tasks as data. A task compares its rows with all of them by one matrix product, decides near ties by the
distances themselves (so results do not depend on how wide the centres are), and hands on one sum for
each centre, whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dimension, mean_vectors, squared_distance
from ..runtime import reliable_checkpoint

ITERATIONS = 5
#: Centres of all groups are held by the driver and by each task up to so many bytes; beyond it they meet rows in a shuffle.
CENTRE_BYTES = 64 << 20
#: Numbers of one block of a matrix product.
BLOCK = 1 << 20


def seeded_hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def nearest(v: Column, centres: Column) -> Column:
    """The cid of the nearest of array<struct<cid, centre>>, the lowest of equally near ones."""
    return F.array_min(F.transform(centres, lambda c: F.struct(squared_distance(v, c["centre"]).alias("d"), c["cid"].alias("cid"))))["cid"]


def _check(k: int, rows: int) -> None:
    if k <= 0:
        raise ValueError("the number of clusters must be positive")
    if k > rows:
        raise ValueError(f"{k} clusters of {rows} rows")


def nearest_index(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For each row the first of its nearest centres: by the product, and by distance where that cannot tell."""
    half = (matrix**2).sum(axis=1) / 2
    out, step = np.zeros(len(x), np.int64), max(1, BLOCK // len(matrix))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        score = half - part @ matrix.T
        limit = score.min(axis=1) + 1e-11 * ((part**2).sum(axis=1) + 2 * half.max() + 1e-300)
        near = score <= limit[:, None]
        out[at : at + step] = near.argmax(axis=1)
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            some = np.flatnonzero(near[i])
            out[at + i] = some[((part[i] - matrix[some]) ** 2).sum(axis=1).argmin()]
    return out


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector, and the vectors of those."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    found = column.drop_null()
    return there, found.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(found), -1 if len(found) else 0)


def nearest_of(v: Column, centres: list[tuple[int, list[float]]]) -> Column:
    """The cid of the nearest centre; null for a null vector."""
    order = sorted(centres)
    cids, matrix = np.array([c for c, _ in order], np.int64), np.array([x for _, x in order], np.float64)

    @F.arrow_udf("bigint")
    def product(vectors: pa.Array) -> pa.Array:
        there, x = _vectors(vectors)
        out = np.zeros(len(there), np.int64)
        if len(x):
            out[there] = cids[nearest_index(x, matrix)]
        return pa.array(out, pa.int64(), mask=~there)

    return product(v)


#: Centres by k and group: (cids, matrix).
Centres = dict[tuple[int, object], tuple[np.ndarray, np.ndarray]]


def _sums(rows: DataFrame, group: str | None, column: str, centres: Centres) -> DataFrame:
    """(k, g, cid, n, s): of each task, how many of its rows are nearest to each centre, and their sum."""
    ks = sorted({k for k, _ in centres})
    kind = "int" if group is None else rows.schema[group].dataType.simpleString()
    narrow = rows.select((F.lit(0) if group is None else F.col(group)).alias("g"), F.col(column).cast("array<double>").alias("v")).where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, object], tuple[np.ndarray, np.ndarray]] = {}
        arrow = None
        for batch in batches:
            arrow = batch.column("g").type
            _, x = _vectors(batch.column("v"))
            groups = batch.column("g").dictionary_encode()
            places = groups.indices.to_numpy(zero_copy_only=False)
            for at, g in enumerate(groups.dictionary.to_pylist()):
                mine = x[places == at]
                for k in ks:
                    if (k, g) not in centres:
                        continue
                    matrix = centres[k, g][1]
                    near = nearest_index(mine, matrix)
                    n, s = held.setdefault((k, g), (np.zeros(len(matrix), np.int64), np.zeros(matrix.shape)))
                    n += np.bincount(near, minlength=len(matrix))
                    for c in np.unique(near):
                        s[c] += mine[near == c].sum(axis=0)
        found = [(k, g, int(centres[k, g][0][c]), int(n[c]), s[c]) for (k, g), (n, s) in held.items() for c in np.flatnonzero(n)]
        if found:
            types = (pa.int32(), arrow, pa.int64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["k", "g", "cid", "n", "s"])

    return narrow.mapInArrow(run, f"k int, g {kind}, cid bigint, n bigint, s array<double>")


def _step(rows: DataFrame, group: str | None, column: str, centres: Centres) -> Centres:
    """The means of the rows nearest to each centre; a centre without rows disappears."""
    dim = next(iter(centres.values()))[1].shape[1]
    means = mean_of_sums(_sums(rows, group, column, centres), ["k", "g", "cid"], dim).collect()
    out: dict[tuple[int, object], list] = {}
    for r in sorted(means, key=lambda r: r.cid):
        out.setdefault((r.k, r.g), []).append(r)
    return {key: (np.array([r.cid for r in some]), np.array([r.mean for r in some])) for key, some in out.items()}


def mean_of_sums(sums: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """(keys, mean): a row for each task and key meets those of its key in one place, read as a stream."""
    schema = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys) + ", mean array<double>"
    spread = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        types: list = []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            n, s = batch.column("n").to_pylist(), batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                own = total.setdefault(key, [0, np.zeros(dim)])
                own[0] += n[i]
                own[1] += s[i]
        if total:
            columns = [pa.array(c, t) for c, t in zip(zip(*total), types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s / n for n, s in total.values()], pa.list_(pa.float64()))], names=[*keys, "mean"])

    return sums.repartition(spread, *keys).mapInArrow(run, schema)


def lloyd(rows: DataFrame, k: int, seed: int = 42, iterations: int = ITERATIONS, key: str = "doc_id", column: str = "embedding") -> list[tuple[int, list[float]]]:
    """Centres as (cid, vector) in order of cid; a centre that loses all rows disappears."""
    start = rows.where(F.col(column).isNotNull()).orderBy(seeded_hash(seed, key), F.col(key)).select(column).limit(max(k, 1)).collect()
    _check(k, len(start))
    centres: Centres = {(k, 0): (np.arange(k), np.array([list(r[0]) for r in start], np.float64))}
    for _ in range(iterations):
        centres = _step(rows, None, column, centres)
    return [(int(c), v.tolist()) for c, v in zip(*centres[k, 0])]


def lloyd_local(vectors: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """The cid of each row after the same steps over a matrix in seeded order, for tables as small as the
    shards of a run."""
    _check(k, len(vectors))
    cids, matrix = np.arange(k), vectors[:k]
    for step in range(iterations + 1):
        near = cids[nearest_index(vectors, matrix)]
        if step < iterations:
            cids = np.unique(near)
            matrix = np.array([vectors[near == c].mean(axis=0) for c in cids])
    return near


def assign(rows: DataFrame, centres: list[tuple[int, list[float]]], out: str = "cluster", column: str = "embedding") -> DataFrame:
    """All columns and the nearest centre's cid: a map over rows, without a join."""
    return rows.withColumn(out, nearest_of(F.col(column), centres))


def grouped_lloyd(rows: DataFrame, group: str, k: int, seed: int = 42, iterations: int = 3, key: str = "doc_id", column: str = "embedding") -> DataFrame:
    """(group, centroid_id, centroid): Lloyd steps within each group, with min(k, rows) starts."""
    return grouped_lloyd_all(rows, group, (k,), seed, iterations, key, column).drop("k")


def grouped_lloyd_all(rows: DataFrame, group: str, ks: tuple[int, ...], seed: int = 42, iterations: int = 3, key: str = "doc_id", column: str = "embedding") -> DataFrame:
    """(k, group, centroid_id, centroid): grouped_lloyd for several k, all in the same passes over the rows."""
    if not ks or min(ks) <= 0:
        raise ValueError("the number of clusters must be positive")
    dim = dimension(rows, column)
    # Filtering row_number() lets each task keep its first rows of a group before the shuffle.
    order = Window.partitionBy(group).orderBy(seeded_hash(seed, key), F.col(key))
    start = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max(ks))
    start = reliable_checkpoint(start.select(F.col(group).alias("g"), (F.col("__n") - 1).cast("bigint").alias("cid"), F.col(column).cast("array<double>").alias("centre")))
    kind = rows.schema[group].dataType.simpleString()
    if start.count() * len(ks) * max(1, dim) * 8 > CENTRE_BYTES:
        return _grouped_by_joins(rows, group, ks, start, iterations, column, dim)
    first: dict[object, list] = {}
    for r in sorted(start.where("centre is not null").collect(), key=lambda r: r.cid):
        first.setdefault(r.g, []).append(r)
    centres: Centres = {}
    for g, some in first.items():
        for k in ks:
            mine = [r for r in some if r.cid < k]
            if mine:
                centres[k, g] = (np.array([r.cid for r in mine]), np.array([list(r.centre) for r in mine]))
    for _ in range(iterations if centres else 0):
        centres = _step(rows, group, column, centres)
    found = [(k, g, int(c), v.tolist()) for (k, g), (cids, matrix) in centres.items() for c, v in zip(cids, matrix)]
    return rows.sparkSession.createDataFrame(found, f"k int, {group} {kind}, centroid_id bigint, centroid array<double>")


def _grouped_by_joins(rows: DataFrame, group: str, ks: tuple[int, ...], start: DataFrame, iterations: int, column: str, dim: int) -> DataFrame:
    """The same steps where all centres are too large for a task: those of a group meet its rows in a shuffle."""
    every = F.explode(F.filter(F.array(*map(F.lit, sorted(ks))), lambda k: k > F.col("cid")))
    centres = start.where("centre is not null").select(every.alias("k"), "g", "cid", "centre")
    for _ in range(iterations):
        packed = reliable_checkpoint(centres.groupBy("k", "g").agg(F.collect_list(F.struct("cid", "centre")).alias("centres")))
        near = rows.join(packed, F.col(group) == F.col("g")).select("k", "g", nearest(F.col(column), F.col("centres")).alias("cid"), F.col(column).alias("v"))
        centres = mean_vectors(near.where("v is not null"), ["k", "g", "cid"], dim, "v", "centre")
    return centres.select("k", F.col("g").alias(group), F.col("cid").cast("bigint").alias("centroid_id"), F.col("centre").alias("centroid"))


def mllib_assign(rows: DataFrame, k: int, seed: int = 42, starts: int = 1, out: str = "cluster", column: str = "embedding") -> DataFrame:
    """Assignment by MLlib's k-means: the best of several seeds by training cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    _check(k, rows.limit(max(k, 1)).count())
    data = rows.withColumn("__v", array_to_vector(F.col(column)))
    models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol=out).fit(data) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("__v").withColumn(out, F.col(out).cast("bigint"))
