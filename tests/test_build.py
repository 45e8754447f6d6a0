from __future__ import annotations

import json
import os
import shutil
import sys
import types
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.__main__ import main
from corvane.operators import quality, store
from corvane.operators.encode import encoder_of, hashed_words
from corvane.plans import build, experiment
from corvane.plans.config import AblationConfig, pilot_config
from corvane.sources import results


@pytest.fixture(scope="module")
def collection(tmp_path_factory):
    root = tmp_path_factory.mktemp("collection")
    (root / "qrels").mkdir()
    (root / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i}", "title": f"t{i % 3}", "text": f"word{i} common text"}) + "\n" for i in range(40)))
    (root / "queries.jsonl").write_text("".join(json.dumps({"_id": f"q{i}", "text": f"word{i} common"}) + "\n" for i in range(5)))
    (root / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"q{i}\td{i}\t1\n" for i in range(5)))
    return root


def test_positions_follow_the_files(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("doc_id"))
    found = store.with_positions(df).collect()
    assert sorted(r.pos for r in found) == list(range(1000))
    assert all(int(r.doc_id) == r.pos for r in found)


def test_chunks_resume(spark, tmp_path):
    corpus = spark.createDataFrame([(str(i), i, "t", f"text {i}") for i in range(10)], "doc_id string, pos bigint, title string, text string")
    path, meta = f"{tmp_path}/docs", f"{tmp_path}/m.json"
    manifest = build.build_corpus_embeddings(corpus, hashed_words(8), path, chunk_size=4, max_docs=9, metadata=meta)
    assert [(r.chunk_idx, r.rows) for r in manifest.orderBy("chunk_idx").collect()] == [(0, 4), (1, 4), (2, 1)]
    files = lambda: {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    build.build_corpus_embeddings(corpus, hashed_words(8), path, chunk_size=4, metadata=meta)
    after = files()
    assert len(before & after) == 2 and len(after - before) == 1
    assert json.load(open(meta))["num_docs"] == 10


def test_command_line(spark, collection, tmp_path):
    common = ["--collection", str(collection), "--embeddings", f"{tmp_path}/e"]
    assert main(["build", *common, "--chunk-size", "16", "--dim", "32", "--batch-size", "7"]) == 0
    assert main(["validate", *common, "--dim", "32"]) == 0
    assert main(["validate", *common, "--dim", "33"]) == 1
    assert main(["coverage", *common]) == 0
    assert main(["chunks", "--embeddings", f"{tmp_path}/e", "--dim", "32"]) == 0
    assert main(["chunks", "--embeddings", f"{tmp_path}/e", "--dim", "33"]) == 1
    (tmp_path / "c.yaml").write_text("dataset: {name: x}\nexperiment: {num_shards: [4], shard_types: [random], top_b_values: [1, 4], centroid_k_values: [2]}\n")
    sweep = ["ablation", *common, "--config", f"{tmp_path}/c.yaml", "--partial", f"{tmp_path}/partial"]
    assert main([*sweep, "--out", f"{tmp_path}/out"]) == 0
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out").collect()
    assert len(rows) == 4 and {float(r.mean_shard_recall) for r in rows if r.top_b == "4"} == {1.0}
    # A second run takes the finished part as it is.
    began = {f: f.stat().st_mtime_ns for f in (tmp_path / "partial").rglob("*.parquet")}
    assert main([*sweep, "--out", f"{tmp_path}/out.csv"]) == 0
    assert began == {f: f.stat().st_mtime_ns for f in (tmp_path / "partial").rglob("*.parquet")}
    data = (tmp_path / "out.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbfdataset,shard_type,") and len(data.splitlines()) == 5


def test_missing_chunks_and_wrong_metadata_are_told(spark, collection, tmp_path):
    common = ["--collection", str(collection), "--embeddings", f"{tmp_path}/e"]
    assert main(["build", *common, "--chunk-size", "16", "--dim", "8", "--no-normalize"]) == 0
    stored = spark.read.parquet(f"{tmp_path}/e/docs")
    assert stored.where("chunk_idx = 0").count() == 16
    meta = json.load(open(f"{tmp_path}/e/metadata.json"))
    assert meta["complete"] and meta["model"] == "hash" and [c["skipped_by_resume"] for c in meta["chunks"]] == [False] * 3
    found = {r.key: r.state for r in quality.metadata_check(spark, meta | {"num_queries": 4, "split": 1, "model": None}, stored, spark.read.parquet(f"{tmp_path}/e/queries")).collect()}
    assert (found["num_docs"], found["num_queries"], found["split"], found["model"]) == ("ok", "differs", "wrong type", "missing")
    shutil.rmtree(f"{tmp_path}/e/docs/chunk_idx=1")
    assert main(["chunks", "--embeddings", f"{tmp_path}/e", "--dim", "8"]) == 1
    assert main(["build", *common, "--chunk-size", "16", "--dim", "8", "--skip-queries"]) == 0
    assert [c["skipped_by_resume"] for c in json.load(open(f"{tmp_path}/e/metadata.json"))["chunks"]] == [True, False, True]


def test_import_command(spark, tmp_path):
    for name, ids, n in (("doc", "doc_ids", 5), ("query", "query_ids", 2)):
        np.save(f"{tmp_path}/{name}_embeddings.npy", np.eye(5, dtype=np.float32)[:n])
        json.dump([f"{name}{i}" for i in range(n)], open(f"{tmp_path}/{ids}.json", "w"))
    assert main(["import", "--matrices", str(tmp_path), "--embeddings", f"{tmp_path}/e", "--chunk-size", "2"]) == 0
    assert main(["chunks", "--embeddings", f"{tmp_path}/e", "--dim", "5"]) == 0
    results.write_matrix(spark.read.parquet(f"{tmp_path}/e/docs"), f"{tmp_path}/back/docs")
    assert (np.load(f"{tmp_path}/back/docs.npy") == np.eye(5)).all() and json.load(open(f"{tmp_path}/back/docs_ids.json")) == [f"doc{i}" for i in range(5)]
    with pytest.raises(ValueError, match="more than"):
        results.write_matrix(spark.read.parquet(f"{tmp_path}/e/docs"), f"{tmp_path}/back/docs", most=8)


def test_a_crashed_sweep_goes_on(spark, tmp_path, monkeypatch):
    """The part that was finished is not computed again, and an unfinished folder is."""
    done = []

    def part(docs, queries, qrels, config, shard_type, num_shards):
        if len(done) == 1:
            done.append("crash")
            raise RuntimeError("lost")
        done.append((num_shards, shard_type))
        return spark.createDataFrame([("d", shard_type, num_shards, 0.5)], "dataset string, shard_type string, num_shards int, x double").select(*[F.col(c) if c in ("dataset", "shard_type", "num_shards") else F.lit(None).cast("int").alias(c) for c in experiment.ROW], "x")

    monkeypatch.setattr(experiment, "evaluate_shards", part)
    config = AblationConfig(num_shards=(2, 4), shard_types=("random",))
    empty = spark.range(1)
    with pytest.raises(RuntimeError):
        experiment.run_ablation(empty, empty, empty, config, f"{tmp_path}/p")
    os.makedirs(f"{tmp_path}/p/{config.fingerprint()}/num_shards=4/shard_type=random/_temporary")
    found = experiment.run_ablation(empty, empty, empty, config, f"{tmp_path}/p")
    assert sorted((r.num_shards, r.x) for r in found.collect()) == [(2, 0.5), (4, 0.5)]
    assert done == [(2, "random"), "crash", (4, "random")] and found.columns == [*experiment.ROW, "x"]
    assert AblationConfig(seed=1).fingerprint() != AblationConfig().fingerprint() == AblationConfig(num_shards=(9,)).fingerprint()


def test_pilot_sweep(spark):
    """48 rows: three cut-offs of one single, three multi, three times one and three grouped variants."""
    draw = np.random.default_rng(3)
    docs = spark.createDataFrame([(str(i), i, v) for i, v in enumerate(draw.normal(size=(160, 6)).tolist())], "doc_id string, pos bigint, embedding array<double>")
    queries = docs.where("pos % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    qrels = docs.where("pos % 4 = 0").select((F.floor(F.col("pos") / 20) * 20).cast("string").alias("query_id"), "doc_id", F.lit(1).alias("rel"))
    rows = experiment.run_ablation(docs, queries, qrels, pilot_config()).collect()
    methods = Counter(r.method for r in rows)
    assert len(rows) == 48 and methods == {"single_centroid": 3, "multi_centroid": 9, "group_single_centroid": 9, "group_multi_centroid": 27}
    assert all((r.mean_group_recall is None) == (not r.method.startswith("group")) and r.num_queries == 8 for r in rows)


def test_encoders(monkeypatch):
    class Model:
        def __init__(self, name, device=None):
            self.name = name

        def encode(self, texts, **_):
            return [[len(t), len(self.name)] for t in texts]

    assert encoder_of("hash", 4)(["a b"]).shape == (1, 4)
    with pytest.raises(RuntimeError, match="sentence-transformers"):
        monkeypatch.setitem(sys.modules, "sentence_transformers", None)
        encoder_of("some/model")(["a"])
    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Model))
    assert encoder_of("some/model")(["abc"]).tolist() == [[3.0, 10.0]]
    assert encoder_of("corvane.operators.encode:hashed_words")(["x"]).shape == (1, 64)


def test_missing_query_text_raises(spark):
    queries = spark.createDataFrame([("q", "x")], "query_id string, text string")
    qrels = spark.createDataFrame([("other", "d", 1)], "query_id string, doc_id string, rel int")
    with pytest.raises(ValueError):
        build.build_query_embeddings(queries, qrels, hashed_words(8), "/nowhere")
