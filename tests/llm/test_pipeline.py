from __future__ import annotations

import pytest

import corpus_pipeline


def test_stage_names_and_registration():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_every_stage_takes_effect(spark, sf_dir, few):
    docs, _ = few
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, seen, sf_dir).collect(), stage(spark, seen, sf_dir).schema)
        if name != "bpe":
            assert out.columns == docs.columns
        if name in ("toxicity", "near_dedup"):
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in seen.collect()} and 0 < out.count() < seen.count()
        if name == "pii":
            assert out.count() == seen.count()
            assert out.where("text like '%@mail_.example.com%'").count() == 0
        seen = out
    assert seen.columns[:2] == ["doc_id", "n_tokens"] and seen.count() > 0


@pytest.mark.parametrize("kind", ["odd", "empty", "clashing"])
def test_odd_inputs(spark, sf_dir, request, kind):
    docs = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "bpe" or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0 and found.where("ids_sha256 is null or n_tokens < 0").count() == 0
