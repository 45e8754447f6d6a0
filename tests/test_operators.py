"""Hand-made rows for each family of operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.vectors import all_finite, dot, norm, normalized
from corvane.operators import clustering, metrics, quality, ranking, representation, sharding, store, text

DOCS = "doc_id string, pos bigint, embedding array<double>"


def docs_of(spark, vectors):
    return spark.createDataFrame([(str(i), i, list(map(float, v))) for i, v in enumerate(vectors)], DOCS)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [tuple(r) for r in df.select(dot(F.col("a"), F.col("b")), norm(F.col("a"))).collect()] == [(11.0, 5.0), (0.0, 0.0)]
    assert [r.a for r in normalized(df, "a").collect()] == [[0.6, 0.8], [0.0, 0.0]]
    odd = spark.createDataFrame([([1.0, float("nan")],), ([1.0, float("-inf")],), ([1.0, 2.0],)], "a array<double>")
    assert [r[0] for r in odd.select(all_finite(F.col("a"))).collect()] == [False, False, True]


@pytest.mark.parametrize(("n", "shards", "sizes"), [(10, 4, [2, 2, 3, 3]), (10, 12, [0, 0] + [1] * 10)])
def test_random_shards_are_balanced(spark, n, shards, sizes):
    found = sharding.random_shards(docs_of(spark, [[1, 0]] * n), shards)
    assert sorted(r.size for r in sharding.shard_sizes(found, shards).collect()) == sizes
    assert rows(found, "ord") == [(i,) for i in range(n)]
    again = sharding.random_shards(docs_of(spark, [[1, 0]] * n).repartition(3), shards)
    assert rows(found, "doc_id", "shard_id") == rows(again, "doc_id", "shard_id")


def test_seeded_rank_within_groups(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("doc_id"), (F.col("id") % 3).alias("g"))
    ranked = sharding.seeded_rank(df, 1, within="g").collect()
    for g in range(3):
        own = sorted((r for r in ranked if r.g == g), key=lambda r: r.ord)
        assert [r.ord for r in own] == list(range(len(own)))
    hashes = {r.doc_id: r.h for r in df.withColumn("h", F.md5(F.concat(F.lit("1:"), "doc_id"))).collect()}
    own = sorted((r for r in ranked if r.g == 0), key=lambda r: r.ord)
    assert [hashes[r.doc_id] for r in own] == sorted(hashes[r.doc_id] for r in own)


def test_heterogeneous_shards_mix_topics(spark):
    df = docs_of(spark, [[1, 0]] * 32).withColumn("topic", F.col("pos") % 4)
    found = sharding.heterogeneous_shards(df, 4, topic_col="topic")
    assert {r["count"] for r in found.groupBy("shard_id", "topic").count().collect()} == {2}


def test_shard_guards(spark):
    df = docs_of(spark, [[1, 0], [0, 1]])
    with pytest.raises(ValueError):
        sharding.build_shards("nothing", df, 2)
    with pytest.raises(ValueError):
        sharding.build_shards("random", df, 0)
    with pytest.raises(ValueError):
        sharding.build_shards("Topic_Based", df, 3)
    with pytest.raises(RuntimeError):
        sharding.require_all_shards(df.withColumn("shard_id", F.lit(0)), 2)
    with pytest.raises(ValueError):
        clustering.lloyd(df, 0)


def test_single_centroids(spark):
    df = docs_of(spark, [[1, 0], [0, 1], [1, 0], [-1, 0]]).withColumn("shard_id", F.floor(F.col("pos") / 2))
    found = {r.shard_id: r.centroid for r in representation.single_centroids(df).collect()}
    assert found[0] == pytest.approx([math.sqrt(0.5)] * 2)
    assert found[1] == [0.0, 0.0]


def test_multi_centroids_keep_to_the_shard_size(spark):
    df = docs_of(spark, [[3, 4], [1, 0], [0, 2], [0, 4]]).withColumn("shard_id", F.when(F.col("pos") == 0, 0).otherwise(1))
    found = representation.multi_centroids(df, k=8)
    assert [r["count"] for r in found.groupBy("shard_id").count().orderBy("shard_id").collect()] == [1, 3]
    assert found.where("shard_id = 0").first().centroid == pytest.approx([0.6, 0.8])


def test_lloyd_separates_clusters_and_ignores_layout(spark):
    vectors = [[0, i % 3] for i in range(9)] + [[50, i % 3] for i in range(9)]
    df = docs_of(spark, vectors)
    found = clustering.assign(df, clustering.lloyd(df, 2, seed=42, iterations=8))
    sides = found.withColumn("side", F.get("embedding", 0)).groupBy("side").agg(F.countDistinct("cluster").alias("n"))
    if {r.n for r in sides.collect()} == {1}:
        again = clustering.assign(df.repartition(3), clustering.lloyd(df.repartition(3), 2, seed=42, iterations=8))
        assert rows(found, "doc_id", "cluster") == rows(again, "doc_id", "cluster")
    else:
        pytest.fail("clusters cross the gap")


def test_nearest_centres_are_those_by_distance():
    """Whatever the size of a block, near ties and equal centres included."""
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(7, 5)) + 1e6
    centres[4] = centres[2]
    x = np.concatenate([draw.normal(size=(200, 5)) + 1e6, centres, (centres[:1] + centres[1:2]) / 2])
    expected = [int(((v - centres) ** 2).sum(axis=1).argmin()) for v in x]
    for block in (1, 70, 1 << 20):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(clustering, "BLOCK", block)
            assert clustering.nearest_index(x, centres).tolist() == expected


def test_clusters_equal_plain_steps(spark):
    draw = np.random.default_rng(7)
    vectors = draw.normal(size=(90, 6))
    df = docs_of(spark, vectors.tolist()).union(spark.createDataFrame([("none", 99, None)], DOCS))
    found = clustering.assign(df, clustering.lloyd(df, 5))
    seeded = [int(r.doc_id) for r in df.where("embedding is not null").orderBy(clustering.seeded_hash(42, "doc_id")).collect()]
    local = clustering.lloyd_local(vectors[seeded], 5)
    assert {r.doc_id: r.cluster for r in found.collect()} == {**{str(i): int(c) for i, c in zip(seeded, local)}, "none": None}


def test_grouped_steps_for_several_k(spark, monkeypatch):
    """All k in one go, each k alone, and by joins where centres are too large to hold."""
    draw = np.random.default_rng(8)
    df = docs_of(spark, draw.normal(size=(60, 4)).tolist()).withColumn("shard_id", F.concat(F.lit("s"), F.col("pos") % 3))
    flat = lambda found: {(r.k, r.shard_id, r.centroid_id): [round(x, 9) for x in r.centroid] for r in found.collect()}
    every = flat(clustering.grouped_lloyd_all(df, "shard_id", (2, 5)))
    alone = {k: v for n in (2, 5) for k, v in flat(clustering.grouped_lloyd(df, "shard_id", n).withColumn("k", F.lit(n))).items()}
    assert every == alone and {(k, g) for k, g, _ in every} == {(k, f"s{i}") for k in (2, 5) for i in range(3)}
    monkeypatch.setattr(clustering, "CENTRE_BYTES", 0)
    assert flat(clustering.grouped_lloyd_all(df, "shard_id", (2, 5))) == every


def test_mllib_gives_every_row_its_nearest_centre(spark):
    df = docs_of(spark, [[0, 0], [0, 1], [9, 9], [9, 8]])
    found = {r.doc_id: r.cluster for r in clustering.mllib_assign(df, 2, starts=2).collect()}
    assert found["0"] == found["1"] != found["2"] == found["3"]


def test_groups(spark, monkeypatch):
    cents = spark.createDataFrame([(i, [float(i > 1), float(i <= 1)]) for i in range(4)], "shard_id bigint, centroid array<double>")
    groups = representation.shard_groups(cents, 2)
    assert groups.count() == 4
    for bad in (0, 5):
        with pytest.raises(ValueError):
            representation.shard_groups(cents, bad)
    draw = np.random.default_rng(4)
    many = spark.createDataFrame([(i, draw.normal(size=5).tolist()) for i in range(60)], "shard_id bigint, centroid array<double>")
    local = rows(representation.shard_groups(many, 6), "shard_id", "group_id")
    monkeypatch.setattr(representation, "CENTRE_BYTES", 0)
    assert rows(representation.shard_groups(many, 6), "shard_id", "group_id") == local
    one = spark.createDataFrame([(i, 0) for i in range(4)], "shard_id bigint, group_id bigint")
    assert representation.group_centroids(cents, one).first().centroid == pytest.approx([math.sqrt(0.5)] * 2)


@pytest.fixture(scope="module")
def ranked(spark):
    queries = spark.createDataFrame([("q", [0.6, 0.8])], "query_id string, embedding array<double>")
    single = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "shard_id bigint, centroid array<double>")
    return queries, single


def test_ranking_breaks_ties_by_shard(ranked):
    queries, single = ranked
    found = ranking.rank_single(queries, single).orderBy("rank").collect()
    assert [(r.shard_id, round(r.score, 6)) for r in found] == [(1, 0.8), (2, 0.8), (0, 0.6)]
    assert ranking.top_b(ranking.rank_single(queries, single), 5).count() == 3


def test_multi_takes_the_best_centroid(spark, ranked):
    queries, _ = ranked
    many = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "shard_id bigint, centroid_id bigint, centroid array<double>")
    assert ranking.rank_multi(queries, many).first().score == pytest.approx(0.8)


def test_all_groups_selected_equals_no_groups(spark, ranked):
    queries, single = ranked
    groups = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "shard_id bigint, group_id bigint")
    centres = representation.group_centroids(single, groups)
    assert rows(ranking.rank_group_single(queries, centres, groups, single, 2), "shard_id", "rank") == rows(ranking.rank_single(queries, single), "shard_id", "rank")
    one = ranking.rank_group_single(queries, centres, groups, single, 1)
    assert rows(one, "group_id", "shard_id", "rank") == [(1, 1, 1), (1, 2, 2)]


def test_large_sides_meet_in_blocks(spark, ranked, monkeypatch):
    queries, single = ranked
    expected = rows(ranking.rank_single(queries, single), "shard_id", "rank")
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 0)
    assert rows(ranking.rank_single(queries, single), "shard_id", "rank") == expected


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_shard_recall(spark):
    relevant = frame(spark, [("q", 2), ("q", 3), ("q", 4)], "query_id string, shard_id bigint")
    chosen = frame(spark, [("q", 1), ("q", 2)], "query_id string, shard_id bigint")
    both = frame(spark, [("q",), ("none",)], "query_id string")
    assert rows(metrics.shard_recall(chosen, relevant, both), "query_id", "shard_recall") == [("none", 0.0), ("q", pytest.approx(1 / 3))]


def test_coverage_counts_unmapped_documents_on_request(spark):
    qrels = frame(spark, [("q", "a", 1), ("q", "b", 2), ("q", "x", 1), ("q", "c", 0)], "query_id string, doc_id string, rel int")
    placed = frame(spark, [("a", 0), ("b", 1), ("c", 0)], "doc_id string, shard_id bigint")
    chosen = frame(spark, [("q", 0)], "query_id string, shard_id bigint")
    asked = frame(spark, [("q",)], "query_id string")
    assert metrics.doc_coverage(chosen, qrels, placed, asked).first().doc_coverage == pytest.approx(1 / 2)
    assert metrics.doc_coverage(chosen, qrels, placed, asked, True).first().doc_coverage == pytest.approx(1 / 3)
    assert rows(metrics.relevant_shards(qrels, placed), "query_id", "shard_id") == [("q", 0), ("q", 1)]


def test_doc_recall(spark, monkeypatch):
    shards = docs_of(spark, [[1, 0], [0.9, 0], [0, 1], [5, 5]]).withColumn("shard_id", F.when(F.col("pos") < 3, 0).otherwise(1))
    queries = frame(spark, [("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    chosen = frame(spark, [("q", 0)], "query_id string, shard_id bigint")
    qrels = frame(spark, [("q", "0", 1), ("q", "2", 1), ("q", "3", 1)], "query_id string, doc_id string, rel int")
    for k, expected in ((0, 0.0), (1, 1 / 3), (2, 1 / 3), (3, 2 / 3), (9, 2 / 3)):
        assert metrics.doc_recall_at_k(queries, chosen, qrels, shards, k).first().doc_recall == pytest.approx(expected)
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 0)
    assert metrics.doc_recall_at_k(queries, chosen, qrels, shards, 3).first().doc_recall == pytest.approx(2 / 3)


def test_group_metrics(spark):
    relevant = frame(spark, [("q", 2), ("q", 5), ("q", 9)], "query_id string, shard_id bigint")
    groups = frame(spark, [(2, 0), (5, 1), (9, 1)], "shard_id bigint, group_id bigint")
    pick = lambda g: frame(spark, [("q", g)], "query_id string, group_id bigint")
    assert metrics.group_recall(pick(1), relevant, groups).first().group_recall == 0.5
    assert metrics.group_drop_error(pick(2), relevant, groups).first().drop_error is True
    assert metrics.group_drop_error(pick(0), relevant, groups).first().drop_error is False


def test_scoring_cost():
    cost = metrics.scoring_cost
    assert cost("single_centroid", 32) == 32
    assert cost("multi_centroid", 32, 8) == 256
    assert cost("group_single_centroid", 32, None, 4, 1, [8] * 4) == 12
    assert cost("group_multi_centroid", 32, 4, 4, 2, [8] * 4) == 68
    assert cost("group_single_centroid", 5, None, 2, 1, [2, 3]) == 4
    with pytest.raises(ValueError):
        cost("other", 32)
    with pytest.raises(ValueError):
        cost("group_single_centroid", 32)


def test_query_ids_in_numeric_order(spark):
    qrels = frame(spark, [("10", "a", 1), ("9", "a", 1), ("2", "a", 0), ("b", "a", 1)], "query_id string, doc_id string, rel int")
    assert [r.query_id for r in text.select_query_ids(qrels).collect()] == ["2", "9", "10", "b"]
    assert [r.query_id for r in text.select_query_ids(qrels, True).collect()] == ["9", "10", "b"]
    with pytest.raises(ValueError):
        text.require_query_texts(qrels, frame(spark, [("9", "x")], "query_id string, text string"))


def test_doc_text_strips_like_unicode(spark):
    df = frame(spark, [("1", None, " x "), ("2", "t", None), ("3", "a", "b\n")], "doc_id string, title string, text string")
    assert rows(text.doc_text(df), "doc_id", "text") == [("1", "x"), ("2", "t"), ("3", "a b")]


def test_store(spark):
    df = docs_of(spark, [[i, 0] for i in range(10)])
    ask = frame(spark, [(0, 3), (1, 3), (2, 9)], "ord int, pos bigint")
    assert rows(store.strict_gather(df, ask, "pos"), "ord", "doc_id") == [(0, "3"), (1, "3"), (2, "9")]
    with pytest.raises(IndexError):
        store.strict_gather(df, frame(spark, [(0, 10)], "ord int, pos bigint"), "pos")
    with pytest.raises(KeyError):
        store.strict_gather(df, frame(spark, [(0, "x")], "ord int, doc_id string"), "doc_id")
    assert rows(store.slice_positions(df, -3, -1), "pos") == [(7,), (8,)]
    chunks = store.with_chunks(df, 4)
    assert rows(store.chunk_manifest(chunks), "chunk_idx", "start", "end", "rows") == [(0, 0, 4, 4), (1, 4, 8, 4), (2, 8, 10, 2)]
    done = chunks.where("chunk_idx < 2").withColumn("doc_id", F.when(F.col("pos") == 5, "other").otherwise(F.col("doc_id")))
    assert rows(store.resume_pending(chunks, done), "chunk_idx") == [(1,), (2,)]
    listed = store.chunk_manifest(chunks).withColumn("chunk_idx", F.when(F.col("chunk_idx") == 2, 7).otherwise(F.col("chunk_idx")))
    assert [(r.chunk_idx, r.ok) for r in store.chunk_check(chunks, listed, 2).orderBy("chunk_idx").collect()] == [(0, True), (1, True), (2, False), (7, False)]
    ragged = df.withColumn("embedding", F.when(F.col("pos") == 0, F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    shape = store.embedding_shape(ragged, expected_dim=2).first()
    assert (shape.constant_dim, shape.wrong_dim, shape.dim) == (False, 1, 2)


def test_quality(spark):
    df = docs_of(spark, [[1, 0], [0, 1]])
    assert quality.duplicate_ids(df.union(df.limit(1)), "doc_id", "d").first().duplicates == 1
    good = quality.norm_summary(df, "d").first()
    assert (good.finite, good.norms_ok, good.checked) == (True, True, 2)
    assert quality.norm_summary(df.limit(0), "d").first().finite is False
    assert quality.norm_summary(df, "d", sample=1).first().checked == 1
    assert [quality.byte_label(n) for n in (0, 1023, 2048, 3 << 40, 5000 << 40)] == ["0.00 B", "1023.00 B", "2.00 KB", "3.00 TB", "5000.00 TB"]


def test_meta_results(spark, tmp_path):
    from corvane.sources import results

    df = spark.createDataFrame([(1, "é")], "a int, b string")
    results.write_results_file(df, f"{tmp_path}/x/r.csv")
    assert open(f"{tmp_path}/x/r.csv", "rb").read() == b"\xef\xbb\xbfa,b\n1,\xc3\xa9\n"
    results.merge_metadata(f"{tmp_path}/m.json", a=1)
    assert results.merge_metadata(f"{tmp_path}/m.json", b="é") == {"a": 1, "b": "é"}
    part = spark.createDataFrame([(4, "random", 0.5)], "num_shards int, shard_type string, x double")
    results.write_partial(part, f"{tmp_path}/p", 4, "random")
    assert results.read_partial(spark, f"{tmp_path}/p").first().shard_type == "random"
