from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import simhash
from corvane.llm.queries import op9_simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """Smallest reachable index of each unsigned value, by union of all close pairs."""
    a = np.array(values, np.uint64)
    root = list(range(len(a)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = top(i), top(int(j))
            root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(a))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n\x0b\x1c .", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_blocks_do_not_matter(monkeypatch):
    text = b"some words that go on and on " * 50
    expected = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == expected


def test_query_against_brute_force(spark, sf_dir, few):
    _, texts = few
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    roots = brute_components(prints)
    expected = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("most", [2, 8, 64])
def test_links_join_all_close_fingerprints(spark, monkeypatch, most):
    """Scattered and dense values; small lists force every level of the index."""
    draw = np.random.default_rng(most)
    values = set(draw.integers(0, 1 << 63, 60).tolist())
    for base in draw.integers(0, 1 << 63, 4).tolist():
        for _ in range(40):
            flips = draw.choice(12 if base % 2 else 64, draw.integers(1, 6), replace=False)
            values.add(base ^ sum(1 << int(f) for f in flips))
    values = sorted(values)
    monkeypatch.setattr(simhash, "LIST", most)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"))
    found = {r.node: r.root for r in simhash.components(links).collect()}
    groups = {}
    for v, r in zip(signed, brute_components(values)):
        groups.setdefault(r, []).append(v)
    for members in groups.values():
        assert {found.get(v, v) for v in members} == {min(members)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {found[i] for i in range(1, 41)} == {0} and found[101] == 100
    assert simhash.components(edges.limit(0)).count() == 0


def test_size_estimates_do_not_grow_with_rounds(spark, monkeypatch):
    """Joins multiply the estimates of what the rounds before made, and the driver holds these numbers."""
    real, bits = simhash.reliable_checkpoint, []

    def noted(df, eager=True):
        out = real(df, eager)
        bits.append(out._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(simhash, "reliable_checkpoint", noted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert len(bits) > 20 and max(bits) < 1000


def test_broadcast_sides_count_what_they_take(spark, monkeypatch):
    """40,000 keys make a broadcast relation of more than 2 MB: beyond that bound both sides are shuffled, with the same rows."""
    nodes = spark.range(80_000).selectExpr("id as node", "1 as n", "array(id div 2) as prefix")
    monkeypatch.setattr(simhash, "reliable_checkpoint", lambda df: df)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: df.orderBy("node").collect()
    near = simhash.shared_postings(nodes)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 2 << 20)
    far = simhash.shared_postings(nodes)
    assert hinted(near) and not hinted(far)
    assert rows(near) == rows(far) and far.count() == 80_000


def test_odd_rows(odd, empty, clashing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    blank = {r.component_id for r in rows if r.fp == 0}
    assert blank == {2}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(clashing).count() == odd.count()


def test_keep_one(spark, odd, empty, clashing):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert rows.count((1, odd.where("doc_id = 1").first().text)) == 1
    assert [i for i, t in rows if not (t or "").strip()] == [2]
    assert {i for i, _ in rows} >= {5, 7, 8, 9, -3, None}
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_finds_similar_wording(spark):
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    docs, groups = [], {}
    for g in range(60):
        base = draw.choice(words, 300).tolist()
        for c in range(3):
            text = list(base)
            for at in draw.choice(300, 2 * c, replace=False):
                text[at] = str(draw.choice(words))
            docs.append((g * 10 + c, " ".join(text)))
            groups[g * 10 + c] = g
    clean = [(1000 + i, " ".join(draw.choice(words, 200).tolist())) for i in range(100)]
    df = spark.createDataFrame(docs + clean, "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert {i for i, _ in clean} <= kept
    assert {groups[i] for i in kept if i < 1000} == set(range(60))
    assert len([i for i in kept if i < 1000]) <= 62


def around(draw, words, edits, n=200):
    """A text and a copy with isolated words replaced, and their Jaccard similarity by brute force."""
    base = draw.choice(words, n).tolist()
    copy = list(base)
    for at in edits:
        copy[at] = "new" + str(draw.integers(1 << 40))
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, copy)]
    return " ".join(base), " ".join(copy), len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_leaves_texts_below_the_similarity(spark):
    draw = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    docs = []
    for g in range(60):
        x, y, likeness = around(draw, words, range(9, 9 + 6 * 30, 30))
        assert 0.7 < likeness < 0.8
        if bin(brute_fingerprint(x) ^ brute_fingerprint(y)).count("1") <= 3:
            continue  # such texts link by their fingerprints
        docs += [(2 * g, x), (2 * g + 1, y)]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert len(docs) > 80 and kept.count() == len(docs)


def test_candidates_are_complete_at_the_similarity(spark):
    """Pairs just above 0.8 that no fingerprint links, common passages among them."""
    draw = np.random.default_rng(9)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(draw.choice(words, 12))
    docs = []
    for g in range(150):
        x, y, likeness = around(draw, words, range(9, 9 + 4 * 40, 40))
        assert 0.8 <= likeness < 0.85
        if bin(brute_fingerprint(x) ^ brute_fingerprint(y)).count("1") > 3:
            tail = " " + passage if g % 3 == 0 else ""
            docs += [(2 * g, x + tail), (2 * g + 1, y + tail)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(docs) > 200 and kept == {i for i, _ in docs if i % 2 == 0}


@pytest.mark.parametrize("part", [3, 2000])
def test_all_members_of_shared_lists_meet(spark, monkeypatch, part):
    """Pairs about 0.85 whose lists hold many other texts: all texts share most of their words."""
    monkeypatch.setattr(simhash, "LIST_PART", part)
    draw = np.random.default_rng(10)
    words = [f"w{i}" for i in range(4000)]
    shared, docs = draw.choice(words, 100).tolist(), []
    for g in range(80):
        x, y, likeness = around(draw, words, (30, 80), 100)
        x, y = (" ".join(shared) + " " + t for t in (x, y))
        if bin(brute_fingerprint(x) ^ brute_fingerprint(y)).count("1") > 3:
            docs += [(2 * g, x), (2 * g + 1, y)]
    sets = [simhash.shingles(t.encode()) for _, t in docs]
    close = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert close == [(i, i - 1) for i in range(1, len(sets), 2)] and len(close) > 30
    monkeypatch.setattr(simhash, "common_shingles", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert kept == {i for i, _ in docs if i % 2 == 0}
