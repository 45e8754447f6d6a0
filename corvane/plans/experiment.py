"""Evaluating rankings, and the sweep over shard types, methods and parameters.

Queries are ranked once for each variant (method and its parameters); all variants and all cut-offs B are
evaluated together in one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators import ranking, representation
from ..operators.metrics import evaluated_queries, positives, scoring_cost
from ..operators.sharding import build_shards, doc_to_shard
from ..runtime import reliable_checkpoint
from ..sources.results import is_written, read_partial, write_partial
from .config import AblationConfig

ROW = ("dataset", "shard_type", "method", "num_shards", "num_groups", "num_selected_groups", "centroids_per_shard", "top_b", "mean_shard_recall", "mean_oracle_doc_coverage", "mean_selected_shard_count", "accessed_shard_ratio", "accessed_group_ratio", "centroid_scoring_cost", "num_queries", "seed")


def variant_name(method: Column, k: Column, num_groups: Column, num_selected: Column) -> Column:
    return F.concat_ws("/", method, k, F.coalesce(num_groups, F.lit(0)), F.coalesce(num_selected, F.lit(0)))


def evaluate(rankings: DataFrame, relevance: DataFrame, evaluated: DataFrame, top_b_values: tuple[int, ...]) -> DataFrame:
    """(variant, top_b, mean_shard_recall, mean_oracle_doc_coverage, mean_selected_shard_count, num_queries).

    rankings: (variant, query_id, shard_id, rank). relevance: (query_id, shard_id, docs), the positive documents
    of each relevant shard."""
    b = F.explode(F.filter(F.array(*map(F.lit, sorted(top_b_values))), lambda x: x >= F.col("rank")))
    selected = rankings.where(F.col("rank") <= max(top_b_values)).join(evaluated, "query_id").select("variant", "query_id", "shard_id", b.alias("top_b"))
    hits = selected.join(relevance, ["query_id", "shard_id"], "left").groupBy("variant", "top_b", "query_id").agg(F.count("*").alias("selected"), F.count("docs").alias("shards"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"))
    totals = relevance.groupBy("query_id").agg(F.count("*").alias("all_shards"), F.sum("docs").alias("all_docs"))
    return hits.join(totals, "query_id").groupBy("variant", "top_b").agg(
        F.avg(F.col("shards") / F.col("all_shards")).alias("mean_shard_recall"),
        F.avg(F.col("docs") / F.col("all_docs")).alias("mean_oracle_doc_coverage"),
        F.avg("selected").alias("mean_selected_shard_count"),
        F.count("*").alias("num_queries"),
    )


def relevance_of(qrels: DataFrame, placed: DataFrame) -> DataFrame:
    """(query_id, shard_id, docs)."""
    return positives(qrels).join(placed, "doc_id").groupBy("query_id", "shard_id").agg(F.count("*").alias("docs"))


def mean_doc_recall(rankings: DataFrame, queries: DataFrame, evaluated: DataFrame, qrels: DataFrame, shards: DataFrame, top_b_values: tuple[int, ...], k: int) -> DataFrame:
    """(variant, top_b, mean) of document recall at k within the selected shards.

    A document is scored once for each query that reaches its shard with any variant. Its smallest rank within a
    variant tells which cut-offs see it."""
    reached = rankings.where(F.col("rank") <= max(top_b_values)).join(evaluated, "query_id")
    pairs = reached.select("query_id", "shard_id").distinct().join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scores = ranking.docs_of_shards(shards.select("doc_id", "shard_id", "embedding"), pairs, "q").select("query_id", "shard_id", "doc_id", dot(F.col("q"), F.col("embedding")).alias("score"))
    # Within one shard only its k best documents of a query can count.
    per_shard = Window.partitionBy("query_id", "shard_id").orderBy(F.desc("score"), "doc_id")
    best = scores.withColumn("n", F.row_number().over(per_shard)).where(F.col("n") <= k).drop("n")
    b = F.explode(F.filter(F.array(*map(F.lit, sorted(top_b_values))), lambda x: x >= F.col("rank")))
    chosen = reached.select("variant", "query_id", "shard_id", b.alias("top_b")).join(best, ["query_id", "shard_id"])
    order = Window.partitionBy("variant", "top_b", "query_id").orderBy(F.desc("score"), "doc_id")
    top = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    wanted = positives(qrels)
    found = top.join(wanted, ["query_id", "doc_id"], "left_semi").groupBy("variant", "top_b", "query_id").agg(F.count("*").alias("found"))
    cells = reached.select("variant").distinct().crossJoin(F.broadcast(shards.sparkSession.createDataFrame([(x,) for x in top_b_values], "top_b int")))
    asked = wanted.join(evaluated, "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    every = asked.crossJoin(F.broadcast(cells))
    return every.join(found, ["variant", "top_b", "query_id"], "left").groupBy("variant", "top_b").agg(F.avg(F.coalesce("found", F.lit(0)) / F.col("n")).alias("mean"))


def _method(k: Column, grouped: bool) -> Column:
    """k is 0 for the single centroid of a shard."""
    names = ("group_single_centroid", "group_multi_centroid") if grouped else ("single_centroid", "multi_centroid")
    return F.when(k == 0, names[0]).otherwise(names[1])


def _grouped(queries: DataFrame, scores: DataFrame, single: DataFrame, num_groups: int, config: AblationConfig) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """Rankings of all centroid sets and numbers of selected groups; the selected groups; members; group sizes."""
    groups = reliable_checkpoint(representation.shard_groups(single, num_groups, config.seed, config.kmeans_iterations))
    centres = reliable_checkpoint(representation.group_centroids(single, groups))
    sizes = [r["count"] for r in groups.groupBy("group_id").count().collect()]
    options = [g for g in config.num_selected_groups if g <= num_groups]
    g = F.explode(F.filter(F.array(*map(F.lit, options)), lambda x: x >= F.col("group_rank")))
    chosen = ranking.selected_groups(queries, centres, max(options)).select("*", g.alias("num_selected_groups"))
    chosen = reliable_checkpoint(chosen.withColumn("num_groups", F.lit(num_groups)))
    order = Window.partitionBy("k", "num_selected_groups", "query_id").orderBy(F.desc("score"), "group_rank", "shard_id")
    ranked = chosen.join(groups, "group_id").join(scores, ["query_id", "shard_id"]).withColumn("rank", F.row_number().over(order))
    return ranked, chosen, groups, sizes


def evaluate_shards(docs: DataFrame, queries: DataFrame, qrels: DataFrame, config: AblationConfig, shard_type: str, num_shards: int, **options) -> DataFrame:
    """All result rows of one partition of the corpus.

    Queries meet all centroids once, whatever the number of methods; each method ranks those scores."""
    spark = docs.sparkSession
    shards = build_shards(shard_type, docs, num_shards, config.seed, **options)
    shards = reliable_checkpoint(shards.select("doc_id", "pos", "embedding", "shard_id"))
    relevance = reliable_checkpoint(relevance_of(qrels, doc_to_shard(shards)))
    evaluated = reliable_checkpoint(evaluated_queries(queries, relevance))
    queries = queries.join(evaluated, "query_id", "left_semi").select("query_id", "embedding")
    single = reliable_checkpoint(representation.single_centroids(shards))
    sets = [single.select(F.lit(0).alias("k"), "shard_id", "centroid")]
    if config.centroid_k_values:
        many = representation.multi_centroids_all(shards, tuple(config.centroid_k_values), config.seed, config.multi_iterations)
        sets.append(many.select("k", "shard_id", "centroid"))
    centroids = reliable_checkpoint(reduce(DataFrame.unionByName, sets))
    scores = ranking.dot_scores(queries, centroids).groupBy("k", "query_id", "shard_id").agg(F.max("score").alias("score"))
    scores = reliable_checkpoint(scores)

    none = F.lit(None).cast("int")
    order = Window.partitionBy("k", "query_id").orderBy(F.desc("score"), "shard_id")
    plain = scores.withColumn("rank", F.row_number().over(order))
    parts = [plain.select(variant_name(_method(F.col("k"), False), F.col("k"), none, none).alias("variant"), "query_id", "shard_id", "rank")]
    cost = lambda method, *rest: scoring_cost(method, num_shards, *rest)
    table = [("single_centroid", None, None, 0, cost("single_centroid"))]
    table += [("multi_centroid", None, None, k, cost("multi_centroid", k)) for k in config.centroid_k_values]
    group_rows = []
    for num_groups in config.num_groups if config.grouping else ():
        if num_groups >= num_shards or not any(g <= num_groups for g in config.num_selected_groups):
            continue
        ranked, chosen, groups, sizes = _grouped(queries, scores, single, num_groups, config)
        parts.append(ranked.select(variant_name(_method(F.col("k"), True), F.col("k"), F.col("num_groups"), F.col("num_selected_groups")).alias("variant"), "query_id", "shard_id", "rank"))
        for g in (g for g in config.num_selected_groups if g <= num_groups):
            table.append(("group_single_centroid", num_groups, g, 0, cost("group_single_centroid", None, num_groups, g, sizes)))
            table += [("group_multi_centroid", num_groups, g, k, cost("group_multi_centroid", k, num_groups, g, sizes)) for k in config.centroid_k_values]
        group_rows.append(_group_metrics(chosen, relevance, evaluated, groups))
    rankings = reliable_checkpoint(reduce(DataFrame.unionByName, parts))

    facts = spark.createDataFrame(table, "method string, num_groups int, num_selected_groups int, k int, centroid_scoring_cost bigint")
    facts = facts.withColumns({"variant": variant_name(*map(F.col, ("method", "k", "num_groups", "num_selected_groups"))), "centroids_per_shard": F.greatest("k", F.lit(1))})
    cut_offs = spark.createDataFrame([(b,) for b in config.top_b_values], "top_b int")
    # A row for each variant and cut-off, also where no query is evaluated.
    rows = facts.crossJoin(cut_offs).join(evaluate(rankings, relevance, evaluated, config.top_b_values), ["variant", "top_b"], "left")
    rows = rows.fillna(0, ["mean_shard_recall", "mean_oracle_doc_coverage", "mean_selected_shard_count", "num_queries"])
    for k in config.document_recall_k_values:
        recall = mean_doc_recall(rankings, queries, evaluated, qrels, shards, config.top_b_values, k)
        name = f"mean_doc_recall_at_{k}_within_selected_shards"
        rows = rows.join(recall.withColumnRenamed("mean", name), ["variant", "top_b"], "left").fillna(0, [name])
    if group_rows:
        rows = rows.join(reduce(DataFrame.unionByName, group_rows), ["num_groups", "num_selected_groups"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("mean_group_recall", "group_drop_error_rate")})
    rows = rows.withColumns({
        "dataset": F.lit(config.dataset),
        "shard_type": F.lit(shard_type),
        "num_shards": F.lit(num_shards),
        "seed": F.lit(config.seed),
        "accessed_shard_ratio": F.col("mean_selected_shard_count") / num_shards,
        "accessed_group_ratio": F.col("num_selected_groups") / F.col("num_groups"),
    })
    return rows.select(*ROW, *[f"mean_doc_recall_at_{k}_within_selected_shards" for k in config.document_recall_k_values], "mean_group_recall", "group_drop_error_rate")


def _group_metrics(chosen: DataFrame, relevance: DataFrame, evaluated: DataFrame, groups: DataFrame) -> DataFrame:
    """(num_groups, num_selected_groups, mean_group_recall, group_drop_error_rate)."""
    wanted = relevance.join(evaluated, "query_id", "left_semi").join(groups, "shard_id").select("query_id", "group_id").distinct()
    options = chosen.select("num_groups", "num_selected_groups").distinct()
    hit = chosen.select("num_groups", "num_selected_groups", "query_id", "group_id", F.lit(1.0).alias("hit"))
    found = wanted.crossJoin(F.broadcast(options)).join(hit, ["num_groups", "num_selected_groups", "query_id", "group_id"], "left")
    recall = found.groupBy("num_groups", "num_selected_groups", "query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    return recall.groupBy("num_groups", "num_selected_groups").agg(F.avg("recall").alias("mean_group_recall"), F.avg((F.col("recall") == 0).cast("double")).alias("group_drop_error_rate"))


def run_ablation(docs: DataFrame, queries: DataFrame, qrels: DataFrame, config: AblationConfig, partial: str | None = None) -> DataFrame:
    """The result rows of every shard count and type of the config.

    With partial, each of them is written to a folder of its own below that path when it is done, and a run that
    finds such a folder of the same settings does not compute it again."""
    cells = [(n, t) for n in config.num_shards for t in config.shard_types]
    if partial is None:
        return reduce(DataFrame.unionByName, [evaluate_shards(docs, queries, qrels, config, t, n) for n, t in cells])
    root = f"{partial}/{config.fingerprint()}"
    for n, t in cells:
        if not is_written(docs.sparkSession, root, n, t):
            write_partial(evaluate_shards(docs, queries, qrels, config, t, n), root, n, t)
    wanted = docs.sparkSession.createDataFrame(cells, "num_shards int, shard_type string")
    rows = read_partial(docs.sparkSession, root).join(F.broadcast(wanted), ["num_shards", "shard_type"], "left_semi")
    return rows.select(*ROW, *[c for c in rows.columns if c not in ROW])


def skipped_queries(queries: DataFrame, relevance: DataFrame) -> DataFrame:
    """(query_id) of queries with relevant shards that have no embedding, which the means leave out."""
    return relevance.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_anti")


def eval_summary(selected: DataFrame, relevant: DataFrame, evaluated: DataFrame, coverage: DataFrame, recall: DataFrame, num_shards: int) -> DataFrame:
    """One row of means over evaluated queries; 0 where there are none."""
    counts = selected.join(evaluated, "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("selected"))
    per_query = evaluated.join(recall, "query_id").join(coverage, "query_id").join(counts, "query_id")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query.agg(mean("shard_recall").alias("mean_shard_recall"), mean("doc_coverage").alias("mean_oracle_doc_coverage"), mean("selected").alias("mean_selected_shard_count"), (mean("selected") / num_shards).alias("accessed_shard_ratio"), F.count("*").alias("num_queries"))
