from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import shards
from corvane.llm.queries import op7_shards


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 4))
def test_capacity_is_minimal(sizes, k):
    ends = shards.minimax_cuts(np.array(sizes), k)
    assert ends[-1] == len(sizes) and len(ends) <= k and ends == sorted(set(ends))
    most = max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends))
    best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)))) for c in itertools.chain.from_iterable(itertools.combinations(range(1, len(sizes)), j) for j in range(min(k, len(sizes)))))
    assert most == best


def check(rows, texts_of):
    slots, where, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    for r in rows:
        for t in texts_of(r):
            where[t].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    return sizes


def test_query(spark, sf_dir, few):
    _, texts = few
    rows = op7_shards(spark, sf_dir).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    sizes = check(rows, lambda r: [texts[r.doc_id]])
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(len(t.encode()) for t in texts.values())
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_hot_groups_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shards, "PART_ROWS", 10)
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    rows = shards.shard_documents(df).collect()
    sizes = check(rows, lambda r: ["copy" if r.doc_id % 3 == 0 else r.doc_id])
    assert len(rows) == 900 and max(sizes.values()) == 1500


@pytest.mark.parametrize("k", [1, 3])
def test_odd_rows(odd, empty, clashing, k):
    rows = shards.shard_documents(odd, k).collect()
    assert len(rows) == odd.count()
    check(rows, lambda r: [r.text_crc32])
    assert shards.shard_documents(empty).count() == 0
    assert shards.shard_documents(clashing).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
