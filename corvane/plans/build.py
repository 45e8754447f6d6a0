"""Building embedding tables chunk by chunk, with resumption, and validating them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, store, text
from ..operators.encode import Encoder, encode_texts
from ..sources.results import merge_metadata, read_if_there


def build_corpus_embeddings(corpus: DataFrame, encoder: Encoder, path: str, chunk_size: int = 100_000, max_docs: int | None = None, resume: bool = True, batch_size: int = 128, metadata: str | None = None, normalize: bool = True, **facts) -> DataFrame:
    """Encode a corpus (doc_id, title, text[, pos]) into Parquet folders of one chunk each; returns their manifest.

    With resume, chunks that are there with the same ids are left as they are; others are written anew. The metadata
    file says complete: false while that goes on, and lists which chunks were skipped by resumption afterwards."""
    spark, began = corpus.sparkSession, time.time()
    placed = corpus if "pos" in corpus.columns else store.with_positions(corpus)
    chunks = store.with_chunks(text.doc_text(placed, "pos"), chunk_size, max_docs)
    done = read_if_there(spark, path) if resume else None
    skipped: set[int] = set()
    if done is not None:
        # A row for each chunk.
        pending = {r.chunk_idx for r in store.resume_pending(chunks, done.select("chunk_idx", "doc_id")).collect()}
        skipped = {r.chunk_idx for r in done.select("chunk_idx").distinct().collect()} - pending
        chunks = chunks.join(F.broadcast(spark.createDataFrame([(c,) for c in sorted(pending)], "chunk_idx bigint")), "chunk_idx", "left_semi")
    if metadata:
        merge_metadata(metadata, complete=False, chunk_size=chunk_size, **facts)
    encoded = encode_texts(chunks, encoder, batch_size, normalize, keep=("pos", "chunk_idx"))
    writer = encoded.repartition("chunk_idx").sortWithinPartitions("chunk_idx", "pos").write.mode("overwrite").partitionBy("chunk_idx")
    writer.option("partitionOverwriteMode", "dynamic" if resume else "static").parquet(path)
    manifest = store.chunk_manifest(spark.read.parquet(path))
    if metadata:
        rows = [r.asDict() | {"skipped_by_resume": r.chunk_idx in skipped} for r in manifest.orderBy("chunk_idx").collect()]
        total = sum(r["rows"] for r in rows)
        seconds = time.time() - began
        merge_metadata(metadata, chunks=rows, num_docs=total, seconds=seconds, docs_per_second=total / seconds, complete=True)
    return manifest


def build_query_embeddings(queries: DataFrame, qrels: DataFrame | None, encoder: Encoder, path: str, positive_only: bool = False, batch_size: int = 128, metadata: str | None = None, normalize: bool = True) -> DataFrame:
    """Encode the judged queries (all of them without judgments); a judged query without a text raises. Keys of
    the metadata file that are not the queries' stay as they are."""
    wanted = queries if qrels is None else text.require_query_texts(text.select_query_ids(qrels, positive_only), queries)
    encode_texts(text.query_texts(wanted), encoder, batch_size, normalize, key="query_id").write.mode("overwrite").parquet(path)
    written = queries.sparkSession.read.parquet(path)
    if metadata:
        shape = store.embedding_shape(written, "query_id").first()
        merge_metadata(metadata, num_queries=shape.rows, query_dim=shape.dim)
    return written


def validate(docs: DataFrame, embedded: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, expected_dim: int | None = None, require_all_queries: bool = True) -> DataFrame:
    """(check, ok, fatal) of all checks, and their verdict as the check 'all': norms only warn."""
    spark, rows = docs.sparkSession, []
    for name, table, key in (("docs", docs, "doc_id"), ("queries", embedded, "query_id")):
        shape = store.embedding_shape(table, key, expected_dim).first()
        rows.append((f"{name}_shape", shape.rows > 0 and shape.rows == shape.ids and shape.null_vectors == 0 and shape.constant_dim and shape.wrong_dim == 0, True))
        rows.append((f"{name}_unique", quality.duplicate_ids(table, key, name).first().duplicates == 0, True))
        norms = quality.norm_summary(table, name).first()
        rows += [(f"{name}_finite", norms.finite, True), (f"{name}_norms", norms.norms_ok, False)]
    rows.append(("coverage", quality.dataset_coverage(corpus, queries, qrels, docs, embedded, require_all_queries).first().ok, True))
    rows.append(("all", all(ok for _, ok, fatal in rows if fatal), True))
    return spark.createDataFrame(rows, "check string, ok boolean, fatal boolean")
