"""An embedding table with positions: gathers, batches, chunks and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import all_finite


def batch_profile(docs: DataFrame, batch_size: int) -> DataFrame:
    """(batch, first_pos, end_pos, rows) of consecutive batches; end is exclusive."""
    batch = F.floor(F.col("pos") / batch_size).cast("bigint")
    return docs.groupBy(batch.alias("batch")).agg(F.min("pos").alias("first_pos"), (F.max("pos") + 1).alias("end_pos"), F.count("*").alias("rows"))


def gather_positions(docs: DataFrame, request: DataFrame) -> DataFrame:
    """(ord, pos, doc_id, embedding) for each requested (ord, pos), repeats included; a position outside
    the table raises when strict_gather has checked it."""
    return request.join(docs.select("pos", "doc_id", "embedding"), "pos").select("ord", "pos", "doc_id", "embedding")


def gather_doc_ids(docs: DataFrame, request: DataFrame) -> DataFrame:
    """(ord, doc_id, embedding) for each requested (ord, doc_id)."""
    return request.join(docs.select("doc_id", "embedding"), "doc_id").select("ord", "doc_id", "embedding")


def strict_gather(docs: DataFrame, request: DataFrame, key: str) -> DataFrame:
    """The gather by that key, after a check that nothing is missing (IndexError or KeyError)."""
    lost = [r[0] for r in request.join(docs, key, "left_anti").select(key).limit(10).collect()]
    if lost:
        raise (IndexError if key == "pos" else KeyError)(f"not in the table: {lost}")
    return (gather_positions if key == "pos" else gather_doc_ids)(docs, request)


def slice_positions(docs: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows of a half-open range of positions; negative bounds count from the end."""
    if (start or 0) < 0 or (stop or 0) < 0:
        n = docs.count()
        start = max(0, n + start) if start is not None and start < 0 else start
        stop = max(0, n + stop) if stop is not None and stop < 0 else stop
    kept = docs if start is None else docs.where(F.col("pos") >= start)
    return kept if stop is None else kept.where(F.col("pos") < stop)


def embedding_shape(docs: DataFrame, key: str = "doc_id", expected_dim: int | None = None) -> DataFrame:
    """One row: rows, dim, ids, whether all vectors have one length, and how many miss the expected one."""
    size = F.size("embedding")
    wrong = F.lit(0).cast("bigint") if expected_dim is None else F.count_if(F.coalesce(size != expected_dim, F.lit(True)))
    return docs.agg(
        F.count("*").alias("rows"),
        F.max(size).alias("dim"),
        F.count(key).alias("ids"),
        F.count_if(F.col("embedding").isNull()).alias("null_vectors"),
        F.coalesce(F.min(size) == F.max(size), F.lit(False)).alias("constant_dim"),
        wrong.alias("wrong_dim"),
    )


def with_positions(rows: DataFrame) -> DataFrame:
    """Rows with a dense pos in the order in which the table is read: a count of each partition's rows gives
    the offsets, and no row is shuffled. The table's files must stay as they are meanwhile."""
    numbered = rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    counts = numbered.groupBy("__p").count()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition of the table.
    offsets = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__skip"))
    within = F.col("__i") - F.shiftleft(F.col("__p").cast("bigint"), 33)
    placed = numbered.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))
    return placed.withColumn("pos", F.col("__skip") + within).drop("__p", "__i", "__q", "__skip")


def with_chunks(docs: DataFrame, chunk_size: int, max_docs: int | None = None) -> DataFrame:
    """Rows with chunk_idx; the first max_docs positions where that is given."""
    kept = docs if max_docs is None else docs.where(F.col("pos") < max_docs)
    return kept.withColumn("chunk_idx", F.floor(F.col("pos") / chunk_size).cast("bigint"))


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """(chunk_idx, start, end, rows, dim) for each chunk; end is exclusive."""
    return chunks.groupBy("chunk_idx").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dim"))


def resume_pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """(chunk_idx, rows) of chunks that are absent from the done (chunk_idx, doc_id) rows or hold other ids.

    Ids are compared by count and by an order-free sum of hashes, so a chunk's ids are never gathered."""
    def sums(rows: DataFrame, tag: str) -> DataFrame:
        return rows.groupBy("chunk_idx").agg(F.count("*").alias(f"rows{tag}"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias(f"sum{tag}"))

    both = sums(chunks, "").join(sums(done, "_done"), "chunk_idx", "left")
    same = (F.col("rows") == F.col("rows_done")) & (F.col("sum") == F.col("sum_done"))
    return both.where(~F.coalesce(same, F.lit(False))).select("chunk_idx", "rows")


def chunk_check(chunks: DataFrame, manifest: DataFrame, expected_dim: int) -> DataFrame:
    """(chunk_idx, rows, listed_rows, wrong_dim, not_finite, null_ids, ok) for every chunk on either side."""
    size = F.size("embedding")
    seen = chunks.groupBy("chunk_idx").agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(size != expected_dim, F.lit(True))).alias("wrong_dim"),
        F.count_if(~F.coalesce(all_finite(F.col("embedding")), F.lit(False))).alias("not_finite"),
        F.count_if(F.col("doc_id").isNull()).alias("null_ids"),
    )
    both = seen.join(manifest.select("chunk_idx", F.col("rows").alias("listed_rows")), "chunk_idx", "full")
    ok = (F.col("rows") == F.col("listed_rows")) & (F.col("wrong_dim") == 0) & (F.col("not_finite") == 0) & (F.col("null_ids") == 0)
    return both.withColumn("ok", F.coalesce(ok, F.lit(False)))
