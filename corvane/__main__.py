"""python -m corvane ablation|pilot|build|import|validate|coverage|chunks ..."""

from __future__ import annotations

import argparse

from .runtime import build_session


def parse_args(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="corvane")
    commands = parser.add_subparsers(dest="command", required=True)
    sweep = commands.add_parser("ablation", help="run a sweep and write its result rows as CSV")
    sweep.add_argument("--config", required=True)
    pilot = commands.add_parser("pilot", help="run the pilot sweep of 48 rows")
    for command in (sweep, pilot):
        command.add_argument("--out", required=True, help="folder of the result rows; a name ending in .csv makes one local file with a byte order mark")
        command.add_argument("--partial", help="folder in which finished shard counts and types are kept for a restart")
    build = commands.add_parser("build", help="encode a collection")
    build.add_argument("--encoder", default="hash", help="hash (a stand-in for tests), module:function, or a sentence model")
    build.add_argument("--batch-size", type=int, default=128)
    build.add_argument("--no-normalize", action="store_true")
    build.add_argument("--chunk-size", type=int, default=100_000)
    build.add_argument("--max-docs", type=int)
    build.add_argument("--no-resume", action="store_true")
    build.add_argument("--skip-docs", action="store_true")
    build.add_argument("--skip-queries", action="store_true")
    build.add_argument("--positive-only-queries", action="store_true")
    build.add_argument("--dim", type=int, default=384)
    check = commands.add_parser("validate", help="check an embedding table against its collection")
    check.add_argument("--dim", type=int)
    cover = commands.add_parser("coverage", help="check judgments against embeddings")
    load = commands.add_parser("import", help="write matrix files with id lists as an embedding table")
    load.add_argument("--matrices", required=True, help="folder of a flat or chunked layout")
    load.add_argument("--chunk-size", type=int, default=100_000)
    chunks = commands.add_parser("chunks", help="check every chunk of an embedding table and its metadata")
    chunks.add_argument("--dim", type=int, default=384)
    for command in (sweep, pilot, build, check, cover):
        command.add_argument("--collection", required=True, help="folder of corpus.jsonl, queries.jsonl and qrels/")
        command.add_argument("--split", default="test")
    for command in (sweep, pilot, build, check, cover, load, chunks):
        command.add_argument("--embeddings", required=True, help="folder of docs/ and queries/")
    return parser.parse_args(args)


def _save(rows, out: str) -> None:
    from .sources import results

    (results.write_results_file if out.endswith(".csv") else results.write_results)(rows, out)


def _check_chunks(spark, options, docs, embedded) -> int:
    """Every chunk, the queries, and what the metadata says of both."""
    from pyspark.sql import functions as F

    from .operators import quality, store
    from .sources import results

    listed = results.read_metadata(f"{options.embeddings}/metadata.json")
    manifest = spark.createDataFrame([(c["chunk_idx"], c["rows"]) for c in listed["chunks"]], "chunk_idx bigint, rows bigint") if listed.get("chunks") else store.chunk_manifest(docs)
    found = store.chunk_check(docs, manifest, options.dim)
    facts = quality.metadata_check(spark, listed, docs, embedded)
    norms = quality.norm_summary(embedded, "queries")
    for table in (found.orderBy("chunk_idx"), norms, facts):
        table.show(1000, truncate=False)
    size = docs.agg(F.sum(F.size("embedding").cast("bigint") * 4)).first()[0]
    print("vectors:", quality.byte_label(size or 0))
    bad = found.where("not ok").count() + facts.where("state = 'differs'").count() + norms.where("not finite").count()
    return 1 if bad or not found.count() else 0


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import functions as F

    from .operators.encode import encoder_of
    from .operators import quality, store
    from .plans import build, experiment
    from .plans.config import load_config, pilot_config
    from .sources import beir, embeddings

    options = parse_args(args)
    spark = build_session()
    docs_path, queries_path, metadata = (f"{options.embeddings}/{name}" for name in ("docs", "queries", "metadata.json"))
    if options.command == "import":
        embeddings.write_chunks(store.with_chunks(embeddings.import_matrices(spark, options.matrices), options.chunk_size), docs_path)
        embeddings.import_queries(spark, options.matrices).write.mode("overwrite").parquet(queries_path)
        return 0
    if options.command != "chunks":
        corpus, queries, qrels = beir.read_collection(spark, options.collection, options.split)
    if options.command == "build":
        encoder, normalize = encoder_of(options.encoder, options.dim), not options.no_normalize
        if not options.skip_queries:
            build.build_query_embeddings(queries, qrels, encoder, queries_path, options.positive_only_queries, options.batch_size, metadata, normalize)
        if not options.skip_docs:
            build.build_corpus_embeddings(corpus, encoder, docs_path, options.chunk_size, options.max_docs, not options.no_resume, options.batch_size, metadata, normalize, model=options.encoder, split=options.split).show()
        return 0
    docs = embeddings.read_embeddings(spark, docs_path)
    embedded = spark.read.parquet(queries_path).withColumn("embedding", F.col("embedding").cast("array<double>"))
    if options.command == "chunks":
        stored = spark.read.parquet(docs_path)
        return _check_chunks(spark, options, stored, embedded)
    if options.command == "coverage":
        found = quality.qrels_coverage(qrels, docs, embedded)
        found.show(truncate=False)
        return 0 if found.first().ok else 1
    if options.command == "validate":
        found = build.validate(docs, embedded, corpus, queries, qrels, options.dim, require_all_queries=False)
        found.show(truncate=False)
        return 0 if found.where("check = 'all'").first().ok else 1
    config = pilot_config() if options.command == "pilot" else load_config(options.config)
    _save(experiment.run_ablation(docs, embedded, qrels, config, options.partial), options.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
