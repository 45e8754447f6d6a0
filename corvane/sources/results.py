"""Result tables as CSV, partial results of a sweep, and metadata."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str) -> None:
    """One headed CSV file in a folder; result tables are some hundred rows."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_results_file(results: DataFrame, path: str) -> None:
    """One local CSV file, UTF-8 with a byte order mark, with its folders made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    results.toPandas().to_csv(path, index=False, encoding="utf-8-sig")


_PARTIAL = "num_shards={}/shard_type={}"


def write_partial(results: DataFrame, root: str, num_shards: int, shard_type: str) -> None:
    """The results of one partition of a sweep in a folder of its own: readers see finished ones only."""
    results.drop("num_shards", "shard_type").coalesce(1).write.mode("overwrite").parquet(f"{root}/{_PARTIAL.format(num_shards, shard_type)}")


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is no folder or none of its files is finished. Other failures raise."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def is_written(spark: SparkSession, root: str, num_shards: int, shard_type: str) -> bool:
    """Whether that partition is finished: its one file gets its name when it is whole."""
    return read_if_there(spark, f"{root}/{_PARTIAL.format(num_shards, shard_type)}") is not None


def read_partial(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(root)


def write_matrix(rows: DataFrame, path: str, key: str = "doc_id", column: str = "embedding", most: int = 1 << 30) -> None:
    """An embedding table of bounded size as <path>.npy and <path>_ids.json in order of pos (of the key without one)."""
    import numpy as np

    order = "pos" if "pos" in rows.columns else key
    row = rows.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("d")).first()
    if row.n * max(1, row.d or 0) * 8 > most:
        raise ValueError(f"{row.n} vectors of {row.d} numbers are more than {most} bytes; keep them in Parquet")
    table = rows.orderBy(order).select(key, column).toPandas()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    np.save(f"{path}.npy", np.array(table[column].tolist(), np.float32))
    with open(f"{path}_ids.json", "w", encoding="utf-8") as file:
        json.dump(table[key].astype(str).tolist(), file, ensure_ascii=False)


def read_metadata(path: str) -> dict:
    """The JSON object of a local file, empty where there is none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def merge_metadata(path: str, **values) -> dict:
    """Set keys of a JSON object in a local file and keep its others."""
    known = read_metadata(path) | values
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(known, file, ensure_ascii=False, indent=2)
    return known
