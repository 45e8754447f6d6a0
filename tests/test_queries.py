"""Every query with SQL against DuckDB, invariants of the others, and properties of the sweep."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.plans import experiment, fixtures
from corvane.plans.config import AblationConfig
from corvane.plans.oracles import ORACLES
from corvane.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(columns, rows):
    """Sorted rows with columns by name and floats to five decimals."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    expected = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got.columns, got.collect()) == plain(expected.columns, expected.fetchall())


def test_queries_without_sql():
    assert sorted(set(QUERIES) - set(ORACLES)) == ["encode_hash", "shard_topic_mllib"]


def test_mllib_shards_cover_all_documents(spark, sf_dir):
    found = QUERIES["shard_topic_mllib"](spark, sf_dir)
    assert found.count() == found.select("doc_id").distinct().count() == 500
    assert found.select("shard_id").distinct().count() == 8


def test_encoded_texts_are_units(spark, sf_dir):
    found = QUERIES["encode_hash"](spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("value") * F.col("value")).alias("n"))
    assert found.where(F.abs(F.col("n") - 1) > 1e-3).count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sweep_properties(spark, sf_dir):
    config = AblationConfig(num_shards=(4,), shard_types=("random",), top_b_values=(1, 2, 4), centroid_k_values=(2,), grouping=True, num_groups=(2, 4), num_selected_groups=(1, 2, 3), document_recall_k_values=(5,))
    docs, queries, qrels = (f(spark, sf_dir) for f in (fixtures.doc_embeddings, fixtures.query_embeddings, fixtures.qrels))
    rows = experiment.run_ablation(docs, queries, qrels, config).collect()
    # Two ungrouped methods, and two methods for each of the two selections that two groups allow.
    assert len(rows) == (2 + 2 * 2) * 3
    by = {(r.method, r.centroids_per_shard, r.num_selected_groups, r.top_b): r for r in rows}
    for method, k in (("single_centroid", 1), ("multi_centroid", 2)):
        recalls = [by[method, k, None, b].mean_shard_recall for b in (1, 2, 4)]
        assert recalls == sorted(recalls) and recalls[-1] == pytest.approx(1)
        assert by[method, k, None, 4].mean_oracle_doc_coverage == pytest.approx(1)
        for b in (1, 2, 4):
            assert by["group_" + method, k, 2, b].mean_shard_recall == pytest.approx(by[method, k, None, b].mean_shard_recall)
            assert by["group_" + method, k, 2, b].mean_group_recall == pytest.approx(1)


def test_streaming_centroids(spark, sf_dir, tmp_path):
    from corvane.operators.representation import single_centroids
    from corvane.operators.sharding import random_shards
    from corvane.streaming.centroids import streaming_centroids

    shards = random_shards(fixtures.doc_embeddings(spark, sf_dir), 4).select("doc_id", "shard_id", "embedding")
    shards.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(shards.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming_centroids(stream, 64).writeStream.outputMode("complete").format("memory").queryName("live").start()
    query.processAllAvailable()
    query.stop()
    live = {r.shard_id: r.centroid for r in spark.table("live").collect()}
    for r in single_centroids(shards).collect():
        assert live[r.shard_id] == pytest.approx(r.centroid)
