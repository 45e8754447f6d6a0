from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import zip_longest

import pytest
import xxhash

from corvane.llm import merkle
from corvane.llm.queries import op3_merkle

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def tree(text):
    """Root, leaves in order, paragraph and section hashes, by the definitions."""
    sections, start = [], 0
    for at in range(2, len(text) + 1):
        if text[at - 2 : at] == "\n\n":
            sections.append(text[start:at])
            start = at
    sections = [s for s in [*sections, text[start:]] if s]
    tops, paragraphs, leaves = [], [], []
    for s in sections:
        nodes = []
        for p in re.findall(merkle.PARAGRAPHS, s):
            own = [sha(m[0]) for m in re.finditer(merkle.PIECES, p, re.ASCII)]
            leaves += own
            nodes.append(sha("".join(own)))
        paragraphs += nodes
        tops.append(sha("".join(nodes)))
    return sha("".join(tops)), leaves, paragraphs, tops


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def order(row):
    i, t = row
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return i is None, -(i or 0), h - (1 << 64) if h >> 63 else h, t.encode()


def brute(rows):
    """rows: (doc_id, text); expected results by descending id, null last, then the text's hash."""
    rows = sorted(((i, t or "") for i, t in rows), key=order)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, new, other = tree(t), tree(edited), tree(after)
        changed = [",".join(str(n) for n, (a, b) in enumerate(zip_longest(own[level], new[level])) if a != b) for level in (3, 2)]
        out.append((i, len(t), sha(edited), own[0], new[0], round(dice(own[1], new[1]), 9), round(dice(own[1], other[1]), 9), *changed))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.edited_sections, r.edited_paragraphs) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf_dir, few):
    _, texts = few
    assert got(op3_merkle(spark, sf_dir)) == brute(texts.items())


@pytest.mark.parametrize("rows", [1, 2, 1000])
def test_runs_do_not_matter(spark, few, monkeypatch, rows):
    df, texts = few
    monkeypatch.setattr(merkle, "RUN_ROWS", rows)
    found = {r.i: r.after for r in merkle.with_next(df).collect()}
    ids = sorted(texts, reverse=True)
    assert found == {i: texts[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}


def test_hot_ids_and_texts_are_split(spark, monkeypatch):
    """A third of all rows share an id, a third have none, and many of both are equal."""
    monkeypatch.setattr(merkle, "RUN_ROWS", 5)
    rows = [(7, f"text {k}") for k in range(60)] + [(7, "again")] * 40 + [(None, f"null {k}") for k in range(60)] + [(None, "same")] * 40 + [(k, f"own {k}") for k in range(-50, 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    plan = merkle.plan_runs(df.selectExpr("doc_id i", "xxhash64(text) h"))
    assert max(plan.parts) >= 10 and plan.parts[-1] >= 10 and len(plan.hot_texts) == 2
    ranked = sorted(rows, key=order)
    expected = Counter((i, t, ranked[(k + 1) % len(ranked)][1]) for k, (i, t) in enumerate(ranked))
    found = merkle.with_next(df)
    assert Counter((r.i, r.t, r.after) for r in found.collect()) == expected


def test_odd_rows(spark, odd, empty, clashing, monkeypatch):
    monkeypatch.setattr(merkle, "RUN_ROWS", 2)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(merkle.compare_with_edits(odd)) == brute(rows)
    assert got(merkle.compare_with_edits(clashing)) == brute(rows)
    assert merkle.compare_with_edits(empty).count() == 0
    for part in (odd.where("doc_id = 9"), odd.where("doc_id is null"), odd.where("doc_id = 2")):
        assert got(merkle.compare_with_edits(part)) == brute([(r.doc_id, r.text) for r in part.collect()])


def test_fingerprints(spark):
    texts = ["a. b.\nc\n\nd", "a. b.\nc\n\nd", "a. b.\nc\nd", "", None]
    found = merkle.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert found[0].fingerprint == found[1].fingerprint != found[2].fingerprint
    assert found[3].fingerprint == found[4].fingerprint == sha("")
    assert (found[0].n_sections, found[0].n_paragraphs) == (2, 4)
