"""One query for each operator, over the fixtures. Floats are rounded to six decimals."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from ..operators import clustering, encode, metrics, quality, ranking, representation, sharding, store, text
from ..runtime import reliable_checkpoint
from . import experiment
from . import fixtures as fx
from .config import AblationConfig

#: Parameters that the queries and their SQL share.
SEED, SHARDS, TOPICS, GROUPS, SELECTED, TOP_B, TOP_K = 42, 8, 8, 3, 2, 3, 10
MULTI_K, STEPS, MULTI_STEPS, GROUP_STEPS = 4, 5, 3, 5
BATCH, CHUNK, CHECK_QUERIES = 100, 128, 10
COSTS = [("single_centroid", 32, None, None, None, None), ("multi_centroid", 32, 8, None, None, None), ("group_single_centroid", 32, None, 4, 1, [8, 8, 8, 8]), ("group_multi_centroid", 32, 4, 4, 2, [8, 8, 8, 8]), ("group_single_centroid", 5, None, 2, 1, [2, 3]), ("group_multi_centroid", 32, 8, 4, 3, [10, 6, 9, 7])]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def _places(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Vectors as rows of (keys, i, value)."""
    return rows.select(*keys, F.posexplode(vector).alias("i", "value")).select(*keys, "i", r6("value"))


class Run:
    """Frames that one query uses in several places; those that cost a shuffle are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs, self.queries, self.qrels = (f(spark, sf_dir) for f in (fx.doc_embeddings, fx.query_embeddings, fx.qrels))

    @cached_property
    def shards(self) -> DataFrame:
        return reliable_checkpoint(sharding.random_shards(self.docs, SHARDS, SEED))

    @cached_property
    def placed(self) -> DataFrame:
        return sharding.doc_to_shard(self.shards)

    @cached_property
    def single(self) -> DataFrame:
        return reliable_checkpoint(representation.single_centroids(self.shards))

    @cached_property
    def multi(self) -> DataFrame:
        return reliable_checkpoint(representation.multi_centroids(self.shards, MULTI_K, SEED, MULTI_STEPS))

    @cached_property
    def groups(self) -> DataFrame:
        return representation.shard_groups(self.single, GROUPS, SEED, GROUP_STEPS)

    @cached_property
    def centres(self) -> DataFrame:
        return representation.group_centroids(self.single, self.groups)

    @cached_property
    def selected(self) -> DataFrame:
        return reliable_checkpoint(ranking.top_b(ranking.rank_single(self.queries, self.single), TOP_B))

    @cached_property
    def relevant(self) -> DataFrame:
        return reliable_checkpoint(metrics.relevant_shards(self.qrels, self.placed))

    @cached_property
    def evaluated(self) -> DataFrame:
        return metrics.evaluated_queries(self.queries, self.relevant)


@query
def scan_embeddings(spark, sf_dir):
    return fx.doc_embeddings(spark, sf_dir).select("doc_id", "pos", F.size("embedding").alias("dim"), F.round(F.get("embedding", 0), 6).alias("first_value"))


@query
def batch_profile(spark, sf_dir):
    return store.batch_profile(fx.doc_embeddings(spark, sf_dir), BATCH)


def _request(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = fx.doc_embeddings(spark, sf_dir).agg(F.max("pos").alias("n"))
    fixed = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, 0), (5, 42)], "ord int, pos bigint")
    return fixed.unionByName(last.select(F.lit(4).alias("ord"), F.col("n").alias("pos")))


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.select("ord", "doc_id", F.round(F.get("embedding", 0), 6).alias("first_value"), F.round(F.get("embedding", 63), 6).alias("last_value"))


@query
def gather_positions(spark, sf_dir):
    return _gathered(store.strict_gather(fx.doc_embeddings(spark, sf_dir), _request(spark, sf_dir), "pos"))


@query
def gather_doc_ids(spark, sf_dir):
    request = _request(spark, sf_dir).select("ord", F.col("pos").cast("string").alias("doc_id"))
    return _gathered(store.strict_gather(fx.doc_embeddings(spark, sf_dir), request, "doc_id"))


@query
def embedding_shape(spark, sf_dir):
    return store.embedding_shape(fx.doc_embeddings(spark, sf_dir), expected_dim=64)


@query
def qrels_profile(spark, sf_dir):
    return quality.qrels_profile(fx.raw_qrels(spark, sf_dir))


@query
def chunk_manifest(spark, sf_dir):
    return store.chunk_manifest(store.with_chunks(fx.doc_embeddings(spark, sf_dir), CHUNK))


@query
def resume_pending_chunks(spark, sf_dir):
    chunks = store.with_chunks(fx.doc_embeddings(spark, sf_dir), CHUNK)
    done = chunks.where("chunk_idx in (0, 2)").select("chunk_idx", "doc_id")
    return store.resume_pending(chunks, done)


@query
def chunk_check(spark, sf_dir):
    chunks = store.with_chunks(fx.doc_embeddings(spark, sf_dir), CHUNK)
    return store.chunk_check(chunks, store.chunk_manifest(chunks).where("chunk_idx <> 1"), 64)


@query
def doc_text(spark, sf_dir):
    return text.doc_text(fx.corpus(spark, sf_dir))


@query
def query_texts(spark, sf_dir):
    return text.query_texts(fx.query_text_rows(spark, sf_dir))


@query
def qrels_positive(spark, sf_dir):
    return metrics.positives(text.normalize_qrels(fx.qrels(spark, sf_dir)))


@query
def select_query_ids(spark, sf_dir):
    return text.select_query_ids(fx.qrels(spark, sf_dir), positive_only=True)


@query
def missing_query_texts(spark, sf_dir):
    return text.missing_query_texts(fx.query_embeddings(spark, sf_dir), fx.query_text_rows(spark, sf_dir))


@query
def shard_random(spark, sf_dir):
    return sharding.random_shards(fx.doc_embeddings(spark, sf_dir), SHARDS, SEED).select("doc_id", "ord", "shard_id")


@query
def shard_topic(spark, sf_dir):
    shards = sharding.topic_shards(fx.doc_embeddings(spark, sf_dir), SHARDS, SEED, STEPS)
    return shards.select("doc_id", "shard_id")


@query
def shard_topic_mllib(spark, sf_dir):
    shards = sharding.topic_shards(fx.doc_embeddings(spark, sf_dir), SHARDS, SEED, method="mllib")
    return shards.select("doc_id", "shard_id")


@query
def shard_heterogeneous(spark, sf_dir):
    shards = sharding.heterogeneous_shards(fx.doc_embeddings(spark, sf_dir), SHARDS, TOPICS, SEED, STEPS)
    return shards.select("doc_id", "topic_id", "ord", "shard_id")


@query
def kmeans_assign(spark, sf_dir):
    docs = fx.doc_embeddings(spark, sf_dir)
    return clustering.assign(docs, clustering.lloyd(docs, TOPICS, SEED, STEPS)).select("doc_id", "cluster")


@query
def doc_to_shard(spark, sf_dir):
    return Run(spark, sf_dir).placed


@query
def shard_size_summary(spark, sf_dir):
    return sharding.shard_size_summary(Run(spark, sf_dir).shards, SHARDS).withColumn("mean_size", r6("mean_size"))


@query
def single_centroids(spark, sf_dir):
    return _places(Run(spark, sf_dir).single, "centroid", "shard_id")


@query
def multi_centroids(spark, sf_dir):
    return _places(Run(spark, sf_dir).multi, "centroid", "shard_id", "centroid_id")


@query
def l2_normalize(spark, sf_dir):
    docs = fx.doc_embeddings(spark, sf_dir)
    scaled = docs.select("doc_id", F.transform("embedding", lambda x: x * F.col("pos")).alias("v"))
    # Adding 0 turns a negative zero into zero.
    return _places(normalized(scaled, "v"), "v", "doc_id").withColumn("value", F.col("value") + 0.0)


@query
def shard_groups(spark, sf_dir):
    return Run(spark, sf_dir).groups


@query
def group_centroids(spark, sf_dir):
    return _places(Run(spark, sf_dir).centres, "centroid", "group_id")


@query
def group_size_summary(spark, sf_dir):
    return representation.group_size_summary(Run(spark, sf_dir).groups).withColumn("mean_size", r6("mean_size"))


@query
def dot_scores(spark, sf_dir):
    run = Run(spark, sf_dir)
    scores = ranking.dot_scores(run.queries, run.single)
    return scores.select("query_id", "shard_id", r6("score"))


def _ranking(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("query_id", *names, r6("score"), "rank")


@query
def rank_single(spark, sf_dir):
    run = Run(spark, sf_dir)
    return _ranking(ranking.rank_single(run.queries, run.single), "shard_id")


@query
def rank_multi(spark, sf_dir):
    run = Run(spark, sf_dir)
    return _ranking(ranking.rank_multi(run.queries, run.multi), "shard_id")


@query
def rank_groups(spark, sf_dir):
    run = Run(spark, sf_dir)
    return _ranking(ranking.rank_groups(run.queries, run.centres), "group_id")


@query
def rank_group_single(spark, sf_dir):
    run = Run(spark, sf_dir)
    return _ranking(ranking.rank_group_single(run.queries, run.centres, run.groups, run.single, SELECTED), "group_id", "group_rank", "shard_id")


@query
def rank_group_multi(spark, sf_dir):
    run = Run(spark, sf_dir)
    return _ranking(ranking.rank_group_multi(run.queries, run.centres, run.groups, run.multi, SELECTED), "group_id", "group_rank", "shard_id")


@query
def top_b_shards(spark, sf_dir):
    return _ranking(Run(spark, sf_dir).selected, "shard_id")


@query
def relevant_shards(spark, sf_dir):
    return Run(spark, sf_dir).relevant


@query
def evaluated_queries(spark, sf_dir):
    return Run(spark, sf_dir).evaluated


@query
def shard_recall(spark, sf_dir):
    run = Run(spark, sf_dir)
    return metrics.shard_recall(run.selected, run.relevant, run.queries).select("query_id", r6("shard_recall"))


def _coverage(spark: SparkSession, sf_dir: str, count_unmapped: bool) -> DataFrame:
    run = Run(spark, sf_dir)
    found = metrics.doc_coverage(run.selected, run.qrels, run.placed, run.queries, count_unmapped)
    return found.select("query_id", r6("doc_coverage"))


@query
def oracle_doc_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir, False)


@query
def oracle_doc_coverage_all(spark, sf_dir):
    return _coverage(spark, sf_dir, True)


@query
def doc_recall_at_k(spark, sf_dir):
    run = Run(spark, sf_dir)
    found = metrics.doc_recall_at_k(run.queries, run.selected, run.qrels, run.shards, TOP_K)
    return found.select("query_id", r6("doc_recall"))


@query
def group_recall(spark, sf_dir):
    run = Run(spark, sf_dir)
    chosen = ranking.selected_groups(run.queries, run.centres, 1)
    return metrics.group_recall(chosen, run.relevant, run.groups).select("query_id", r6("group_recall"))


@query
def group_drop_error(spark, sf_dir):
    run = Run(spark, sf_dir)
    return metrics.group_drop_error(ranking.selected_groups(run.queries, run.centres, 1), run.relevant, run.groups)


@query
def scoring_cost(spark, sf_dir):
    rows = [(i, c[0], metrics.scoring_cost(*c)) for i, c in enumerate(COSTS)]
    return spark.createDataFrame(rows, "case_id int, method string, cost bigint")


@query
def actual_scoring_cost(spark, sf_dir):
    return metrics.actual_scoring_cost(Run(spark, sf_dir).multi)


@query
def eval_summary(spark, sf_dir):
    run = Run(spark, sf_dir)
    coverage = metrics.doc_coverage(run.selected, run.qrels, run.placed, run.queries)
    summary = experiment.eval_summary(run.selected, run.relevant, run.evaluated, coverage, metrics.shard_recall(run.selected, run.relevant), SHARDS)
    return summary.select(*[r6(c) if c != "num_queries" else F.col(c) for c in summary.columns])


#: Two shard types, single and two multi-centroid settings, with and without two groupings.
GRID = AblationConfig(dataset="fixture", seed=SEED, num_shards=(SHARDS,), shard_types=("random", "topic_based"), top_b_values=(1, 3), centroid_k_values=(2, 4), grouping=True, num_groups=(GROUPS,), num_selected_groups=(1, 2), document_recall_k_values=(TOP_K,), kmeans_iterations=GROUP_STEPS, multi_iterations=MULTI_STEPS)


@query
def ablation_grid(spark, sf_dir):
    rows = experiment.run_ablation(fx.doc_embeddings(spark, sf_dir), fx.query_embeddings(spark, sf_dir), fx.qrels(spark, sf_dir), GRID)
    floats = {c for c, kind in rows.dtypes if kind == "double"}
    return rows.select(*[r6(c) if c in floats else F.col(c) for c in rows.columns])


@query
def duplicate_ids(spark, sf_dir):
    docs = fx.doc_embeddings(spark, sf_dir).select("doc_id")
    twice = docs.union(docs.where("doc_id in ('0', '7')"))
    queries = fx.query_embeddings(spark, sf_dir)
    return quality.duplicate_ids(twice, "doc_id", "docs").unionByName(quality.duplicate_ids(queries, "query_id", "queries"))


@query
def norm_summary(spark, sf_dir):
    docs = fx.doc_embeddings(spark, sf_dir)
    rows = quality.norm_summary(docs, "docs").unionByName(quality.norm_summary(fx.query_embeddings(spark, sf_dir), "queries")).unionByName(quality.norm_summary(docs, "sample", sample=128))
    return rows.select("name", "checked", "not_finite", r6("min_norm"), r6("mean_norm"), r6("max_norm"), "finite", "norms_ok")


@query
def dataset_coverage(spark, sf_dir):
    row = quality.dataset_coverage(fx.corpus(spark, sf_dir), fx.query_text_rows(spark, sf_dir), fx.qrels(spark, sf_dir), fx.doc_embeddings(spark, sf_dir), fx.query_embeddings(spark, sf_dir))
    return row.withColumns({c: F.round(c, 6) for c in ("coverage", "positives_per_judged_query")})


@query
def topk_hit_rate(spark, sf_dir):
    row = quality.topk_hit_rate(fx.doc_embeddings(spark, sf_dir), fx.query_embeddings(spark, sf_dir), fx.qrels(spark, sf_dir), CHECK_QUERIES, TOP_K)
    return row.withColumn("hit_rate", F.round("hit_rate", 6))


@query
def qrels_coverage(spark, sf_dir):
    row = quality.qrels_coverage(fx.qrels(spark, sf_dir), fx.doc_embeddings(spark, sf_dir), fx.query_embeddings(spark, sf_dir))
    return row.withColumn("positives_per_positive_query", F.round("positives_per_positive_query", 6))


@query
def missing_positive_docs(spark, sf_dir):
    return quality.missing_positive_docs(fx.qrels(spark, sf_dir), fx.doc_embeddings(spark, sf_dir))


@query
def skipped_queries(spark, sf_dir):
    return experiment.skipped_queries(fx.query_embeddings(spark, sf_dir), Run(spark, sf_dir).relevant)


@query
def dataset_summary(spark, sf_dir):
    return quality.dataset_summary(fx.corpus(spark, sf_dir), fx.query_text_rows(spark, sf_dir), fx.qrels(spark, sf_dir))


@query
def encode_hash(spark, sf_dir):
    encoded = encode.encode_texts(text.doc_text(fx.corpus(spark, sf_dir)), encode.hashed_words(64))
    return _places(encoded.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding", "doc_id").where("value <> 0")
