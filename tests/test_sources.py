from __future__ import annotations

import json

import numpy as np
import pytest

from corvane.operators import store
from corvane.plans.config import load_config, parse_config, pilot_config
from corvane.sources import beir, embeddings


def test_collection(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "001", "title": "t", "text": "x"}\n{"_id": "2", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "a"}\n{"_id": "q", "text": "b"}\n{"_id": "r"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t001\t1\nq\t2\t0\n")
    corpus, queries, qrels = beir.read_collection(spark, str(tmp_path))
    assert {(r.doc_id, r.title) for r in corpus.collect()} == {("001", "t"), ("2", None)}
    assert {(r.query_id, r.text) for r in queries.collect()} == {("q", "b"), ("r", "")}
    assert {tuple(r) for r in qrels.collect()} == {("q", "001", 1), ("q", "2", 0)}
    files = {r.file.rsplit("/", 1)[1]: r.lines for r in beir.raw_profile(spark, str(tmp_path)).collect()}
    assert files == {"corpus.jsonl": 2, "queries.jsonl": 3, "test.tsv": 3}
    (tmp_path / "qrels" / "bad.tsv").write_text("query-id\tscore\nq\t1\n")
    with pytest.raises(ValueError):
        beir.read_qrels(spark, str(tmp_path / "qrels" / "bad.tsv"))


@pytest.mark.parametrize("folder", embeddings.ID_FOLDERS)
def test_chunked_matrices(spark, tmp_path, folder):
    (tmp_path / "doc_chunks").mkdir()
    (tmp_path / folder).mkdir()
    for c in range(2):
        np.save(tmp_path / "doc_chunks" / f"chunk_{c:05d}.npy", np.full((3, 2), c, np.float32))
        (tmp_path / folder / f"chunk_{c:05d}.json").write_text(json.dumps([c * 3 + i for i in range(3)]))
    docs = embeddings.import_matrices(spark, str(tmp_path))
    assert sorted((r.doc_id, r.pos, r.embedding[0]) for r in docs.collect()) == [(str(i), i, float(i // 3)) for i in range(6)]
    embeddings.write_chunks(store.with_chunks(docs, 4), f"{tmp_path}/out")
    assert embeddings.read_embeddings(spark, f"{tmp_path}/out").count() == 6
    np.save(tmp_path / "doc_embeddings.npy", np.zeros((1, 2), np.float32))
    (tmp_path / "doc_ids.json").write_text('["flat"]')
    assert [r.doc_id for r in embeddings.import_matrices(spark, str(tmp_path)).collect()] == ["flat"]


def test_matrix_guards(spark, tmp_path):
    np.save(tmp_path / "doc_embeddings.npy", np.zeros((2, 2), np.float32))
    (tmp_path / "doc_ids.json").write_text('["a"]')
    with pytest.raises(ValueError):
        embeddings.import_matrices(spark, str(tmp_path))
    (tmp_path / "doc_ids.json").write_text('["a", "a"]')
    with pytest.raises(ValueError):
        embeddings.import_matrices(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        embeddings.import_matrices(spark, str(tmp_path / "nothing"))
    np.save(tmp_path / "query_embeddings.npy", np.zeros((2, 2), np.float32))
    (tmp_path / "query_ids.json").write_text('["a"]')
    with pytest.raises(ValueError):
        embeddings.import_queries(spark, str(tmp_path))


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("dataset: {name: x}\nexperiment:\n  num_shards: [8]\n  grouping: {enabled: true, num_groups: [2], num_selected_groups: [1]}\nmetrics: {document_recall_k_values: [10]}\n")
    config = load_config(str(tmp_path / "c.yaml"))
    assert (config.dataset, config.num_shards, config.grouping, config.num_groups, config.document_recall_k_values, config.seed) == ("x", (8,), True, (2,), (10,), 42)
    with pytest.raises(ValueError):
        parse_config({"clustering": {"n_init": 3}})
    assert pilot_config().num_shards == (32,)
