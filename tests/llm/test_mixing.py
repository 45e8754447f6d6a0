from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing
from corvane.llm.queries import op5_mixing
from corvane.runtime import reliable_checkpoint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling by repeated resharing. sizes: words by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * share > most * sizes[s]]
        if not over:
            return out | {s: w[s] * share for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= set(over)
    return out


def run(df):
    rows = reliable_checkpoint(mixing.with_draws(df).drop("row"))
    facts, small = mixing.plan_mix(rows)
    return mixing.apply_mix(rows, facts, small).collect()


def check(rows, slack):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = targets(sizes)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r.copies * r["size"]
        assert r.source_size == sizes[r["source"]]
        assert r.target == pytest.approx(want[r["source"]], abs=1e-5)
        assert 0 <= r.copies <= 3
    for s, t in want.items():
        assert abs(taken[s] - t) <= max([0, *(r["size"] for r in rows if r["source"] == s)]) * slack + 1e-6
    return {s: (taken[s], want[s]) for s in want}


def test_query(spark, sf_dir, few):
    df, texts = few
    rows = op5_mixing(spark, sf_dir).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    check(run(df), slack=1.0)
    again = op5_mixing(spark, sf_dir).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}


def odds(sizes, left):
    """Inclusion probabilities in proportion to size, at most 1, whose expected words are those left, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(1, rate * s) * s for s in sizes) < left else (low, rate)
    return [min(1.0, high * s) for s in sizes]


@pytest.mark.parametrize(("bins", "broadcast"), [(1, 1 << 24), (7, 1 << 24), (4096, 0)])
def test_targets_are_met_however_rows_are_binned(spark, monkeypatch, bins, broadcast):
    """A source of a third of all rows, a tiny capped one, one without words, and null."""
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", broadcast)
    source = F.expr("case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('s', id % 5) when id % 60 = 2 then null when id = 5 then 'tiny' else 'plain' end")
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, "").otherwise(F.repeat(F.lit("w "), (F.col("id") * 37 % 50).cast("int"))).alias("text"), source.alias("source"))
    df = df.union(spark.createDataFrame([(9000 + i, " ", "blank") for i in range(3)], "doc_id bigint, text string, source string"))
    rows = run(df)
    found = check(rows, slack=1.0)
    assert all(abs(t - got) <= 0.002 * t + 3 for got, t in found.values() if t > 500)
    taken = sorted((r.id, r.copies) for r in rows)
    # Neither bins nor the kind of join decide anything.
    monkeypatch.undo()
    assert taken == sorted((r.id, r.copies) for r in run(df))


def test_documents_are_drawn_at_their_own_rates(spark):
    """Many sources of the same eleven sizes, four documents of each: each size is drawn about as often as its inclusion probability says, and each
    source draws the number of documents that was fixed before."""
    sizes, sources = [2, 3, 5, 8, 13, 21, 34, 40, 55, 60, 90] * 4, 180
    names = [f"s{i:04d}" for i in range(sources)]
    docs = [(i * 100 + k, "w " * s, n) for i, n in enumerate(names) for k, s in enumerate(sizes)]
    rows = run(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
    want = targets({n: sum(sizes) for n in names})
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    for weight in range(3):
        mine = names[weight::3]
        whole, left = divmod(want[mine[0]], sum(sizes))
        p = odds(sizes, left)
        drawn = Counter()
        for n in mine:
            extra = [r for r in by_source[n] if r.copies > whole]
            assert {r.copies for r in by_source[n]} <= {int(whole), int(whole) + 1} and len(extra) == round(sum(p))
            drawn.update(r["size"] for r in extra)
        p, rates = p[:11], [drawn[s] / len(mine) / 4 for s in sizes[:11]]
        assert all(abs(a - b) <= 0.15 for a, b in zip(rates, p)), (rates, p)
        assert rates[-1] - rates[0] > 0.2 and all(r == 1 for r, x in zip(rates, p) if x == 1)


def test_the_rate_is_solved_exactly(spark):
    """Some documents are certain, and expected words are those left."""
    for sizes in ([1, 1, 1, 500], [10] * 8, [1, 2, 4, 8, 16, 32, 64, 128], [7]):
        rows = spark.createDataFrame([(i, "a", s) for i, s in enumerate(sizes)], "id bigint, source string, size bigint")
        for share in (0.1, 0.5, 0.97):
            left = share * sum(sizes)
            facts = spark.createDataFrame([("a", left)], "source string, left double")
            found = mixing._inclusion(rows, facts).first()
            p = [min(1.0, found.rate * s) for s in sizes]
            assert p == pytest.approx(odds(sizes, left), abs=1e-9) and found.wanted in (round(sum(p) - 1e-9), round(sum(p) + 1e-9))


def test_odd_rows(spark, odd, empty, clashing):
    check(run(odd), slack=1.0)
    assert run(empty) == []
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns
    mixed = Counter((r.doc_id, r.text) for r in out.collect())
    per_row = Counter((r.doc_id, r.text) for r in odd.collect())
    assert all(n <= 3 * per_row[k] for k, n in mixed.items())
    assert mixing.mix_documents(empty).count() == 0
