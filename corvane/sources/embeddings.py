"""Embedding tables: Parquet with ids and positions, and an importer of matrix files with id lists."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that chunked layouts give to the folder of their id lists.
ID_FOLDERS = ("doc_chunk_ids", "doc_id_chunks")
SCHEMA = "doc_id string, pos bigint, embedding array<float>"


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, embedding array<double>) of a Parquet table written by write_chunks or a compatible one."""
    return spark.read.parquet(path).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))


def _flat(folder: str) -> list[tuple[str, str]] | None:
    pair = (f"{folder}/doc_embeddings.npy", f"{folder}/doc_ids.json")
    return [pair] if all(map(os.path.exists, pair)) else None


def _chunked(folder: str) -> list[tuple[str, str]]:
    matrices = sorted(glob.glob(f"{folder}/doc_chunks/chunk_*.npy"))
    found = [d for d in ID_FOLDERS if os.path.isdir(f"{folder}/{d}")]
    if not matrices or not found:
        raise FileNotFoundError(f"{folder} holds neither a flat nor a chunked layout")
    ids = sorted(glob.glob(f"{folder}/{found[0]}/chunk_*.json"))
    if [os.path.basename(m)[:-4] for m in matrices] != [os.path.basename(i)[:-5] for i in ids]:
        raise ValueError("matrix chunks and id chunks differ")
    return list(zip(matrices, ids))


def _checked(pairs: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(matrix, ids, first position) after checks of shapes and dimensions; only headers and ids are read."""
    out, start, dim = [], 0, None
    for matrix, ids in pairs:
        shape = np.load(matrix, mmap_mode="r").shape
        with open(ids, encoding="utf-8") as file:
            n = len(json.load(file))
        if len(shape) != 2 or shape[0] != n:
            raise ValueError(f"{matrix}: shape {shape} for {n} ids")
        if dim not in (None, shape[1]):
            raise ValueError(f"{matrix}: dimension {shape[1]}, not {dim}")
        dim = shape[1]
        out.append((matrix, ids, start))
        start += n
    return out


def import_matrices(spark: SparkSession, folder: str, rows: int = 4096) -> DataFrame:
    """(doc_id, pos, embedding) of matrix files on a file system that driver and executors share. The flat layout
    wins where both are there. One task for each file, mapped rather than loaded; repeated ids raise."""
    pairs = _checked(_flat(folder) or _chunked(folder))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for matrix, ids, start in batch.itertuples(index=False):
                values = np.load(matrix, mmap_mode="r")
                with open(ids, encoding="utf-8") as file:
                    names = [str(i) for i in json.load(file)]
                for a in range(0, len(names), rows):
                    part = np.asarray(values[a : a + rows], np.float32)
                    yield pd.DataFrame({"doc_id": names[a : a + rows], "pos": np.arange(start + a, start + a + len(part)), "embedding": list(part)})

    files = spark.createDataFrame(pairs, "matrix string, ids string, start bigint").repartition(len(pairs))
    docs = files.mapInPandas(load, SCHEMA)
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"document id {twice[0].doc_id!r} is repeated")
    return docs


def import_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, embedding) of query_embeddings.npy and query_ids.json, a set that the driver can hold."""
    values = np.load(f"{folder}/query_embeddings.npy")
    with open(f"{folder}/query_ids.json", encoding="utf-8") as file:
        ids = [str(i) for i in json.load(file)]
    if values.ndim != 2 or len(values) != len(ids):
        raise ValueError(f"shape {values.shape} for {len(ids)} query ids")
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, values)], "query_id string, embedding array<float>")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of Parquet files for each chunk_idx; each chunk is sorted where it is written."""
    chunks.repartition("chunk_idx").sortWithinPartitions("chunk_idx", "pos").write.mode(mode).partitionBy("chunk_idx").parquet(path)
