"""Assigning documents to shards by minimax contiguous partition, in DataFrame operations but for the
search itself, which runs on the driver over a bounded array.

Documents with equal texts are never parted: atomic groups are the texts with the same UNIT_BITS leading
bits of the text's hash, in the order of those bits. Their byte sizes (at most 2**UNIT_BITS numbers, at any
input size) decide the cuts: binary search finds the smallest capacity at which a greedy pass over the
ordered groups fills no more than the wanted number of shards, and the shards are cut within that capacity.

Slots number each shard's rows without gaps. A group is dealt into as many parts as its rows need by a hash
of the id, so that no task numbers a hot group alone; parts' offsets come from their counts.

Edge cases: a null text has no bytes (size 1) and the hash of the empty text; null ids and repeated rows
are rows like any other; equal sort keys are numbered in any order among themselves, which only identical
(id, size) rows can see; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes

UNIT_BITS = 17
#: Rows that one part of a group should hold, and the most parts of a group.
PART_ROWS = 1000
MAX_PARTS = 4096


def greedy_cuts(prefix: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of contiguous runs of at most that capacity, or None when they need more than so many shards."""
    ends, done = [], 0
    n = len(prefix)
    while done < n:
        if len(ends) == shards:
            return None
        base = prefix[done - 1] if done else 0
        end = int(np.searchsorted(prefix, base + capacity, side="right"))
        if end == done:
            return None
        ends.append(end)
        done = end
    return ends


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Ends (exclusive) of at most so many contiguous runs whose largest sum is the least possible.

    Many cuts reach that least capacity. A plain greedy pass fills the first shards to the brim and leaves
    the last one short, so each shard ends next to its even share of what is left, unless the rest would
    then no longer fit."""
    if not len(sizes):
        return []
    prefix = np.cumsum(sizes.astype(np.int64))
    low, high = int(max(sizes.max(), -(-int(prefix[-1]) // shards))), int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    ends, done, n = [], 0, len(prefix)
    while done < n:
        base, left = (int(prefix[done - 1]) if done else 0), shards - len(ends)
        last = int(np.searchsorted(prefix, base + low, side="right"))
        even = int(np.searchsorted(prefix, base + (int(prefix[-1]) - base) / left, side="right"))
        options = sorted({min(max(e, done + 1), last) for e in (even, even + 1)}, key=lambda e: abs(int(prefix[e - 1]) - base - (int(prefix[-1]) - base) / left))
        ends.append(next((e for e in options if _fits(prefix, e, low, left - 1)), last))
        done = ends[-1]
    return ends


def _fits(prefix: np.ndarray, done: int, capacity: int, shards: int) -> bool:
    if done == len(prefix):
        return True
    return shards > 0 and greedy_cuts(prefix[done:] - prefix[done - 1], capacity, shards) is not None


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row."""
    spark = docs.sparkSession
    data = text_bytes(text_col)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias(id_col),
        (F.octet_length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(data), 64 - UNIT_BITS).cast("int").alias("unit"),
    )
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("unit")
    cuts = minimax_cuts(units["bytes"].to_numpy(), shards)
    units["shard"] = np.searchsorted(np.array(cuts), np.arange(len(units)), side="right").astype(np.int32)
    units["parts"] = np.clip(-(-units["rows"].to_numpy() // PART_ROWS), 1, MAX_PARTS).astype(np.int32)
    units["first"] = (units.groupby("shard")["rows"].cumsum() - units["rows"]).astype(np.int64) if len(units) else 0
    schema = "unit int, shard int, parts int, first bigint"
    table = spark.createDataFrame(units[["unit", "shard", "parts", "first"]].astype({"unit": "int32", "shard": "int32", "parts": "int32", "first": "int64"}), schema) if len(units) else spark.createDataFrame([], schema)
    # At most 2**UNIT_BITS rows of 20 bytes, whatever the input.
    rows = rows.join(F.broadcast(table), "unit").withColumn("part", F.pmod(F.xxhash64(F.col(id_col), F.col("size")), F.col("parts")).cast("int"))
    key = ["unit", "part"]
    split = units[units["parts"] > 1]
    if len(split):
        offsets = rows.where(F.col("parts") > 1).groupBy(*key).count()
        earlier = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = offsets.select(*key, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("skip"))
        # One row for each part of a hot group: by PART_ROWS at most one for 1,000 documents, besides one for each group.
        rows = rows.join(offsets, key, "left")
    else:
        rows = rows.withColumn("skip", F.lit(0).cast("bigint"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(id_col).asc_nulls_last(), "size"))
    slot = F.col("first") + F.coalesce(F.col("skip"), F.lit(0)) + number - 1
    return rows.select(id_col, "size", "text_crc32", "shard", slot.cast("bigint").alias("slot"))
