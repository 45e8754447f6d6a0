from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import langid, toxicity
from corvane.llm.queries import op2_toxicity, op10_language


def test_logistic_regression_reaches_the_optimum():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + draw.logistic(size=400) > 0).astype(float)
    w = toxicity.fit_logistic(x, y, ridge=0.01, steps=2000)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    slope = np.r_[x.T @ (p - y) / 400 + 0.01 * w[:-1], (p - y).mean()]
    assert np.abs(slope).max() < 1e-4
    flat = toxicity.fit_logistic(x, np.zeros(400))
    assert not flat[:-1].any() and flat[-1] < -10


def test_later_models_see_unseen_probabilities():
    """The second category equals the first plus noise that the first overfits: folds keep its weight honest."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 55)).astype(np.float32)
    y = draw.integers(0, 2, 60)
    both = np.stack([y, y], axis=1)
    folds = np.arange(60) % toxicity.FOLDS
    honest, unseen = toxicity.fit_chain(x, both, folds)
    assert unseen.shape == (60, 2)
    seen = toxicity._predict(x, honest[0])
    cheating = toxicity.fit_logistic(np.concatenate([x, seen[:, None].astype(np.float32)], axis=1), y.astype(float))
    assert len(honest[1]) == len(honest[0]) + 1
    assert abs(honest[1][55]) < abs(cheating[55])


def test_threshold():
    p, y = np.array([0.1, 0.2, 0.3, 0.9]), np.array([False, False, True, True])
    assert 0.2 < toxicity.best_threshold(p, y) <= 0.3
    assert toxicity.best_threshold(p, np.zeros(4, bool)) == toxicity.THRESHOLD


@pytest.fixture(scope="module")
def toxic_rows(spark):
    draw = np.random.default_rng(2)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = draw.choice(words, draw.integers(20, 120)).tolist()
        if bad:
            for at in draw.choice(len(text), 3):
                text[at] = str(draw.choice(["zorgon", "vexhum", "quimble"])) + str(draw.choice(["", "ix", "ous"]))
        rows.append((i, " ".join(text)))
        if i < 600:
            labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_toxicity(toxic_rows):
    docs, labels = toxic_rows
    found = {r.doc_id: r.toxic for r in toxicity.classify(docs, labels).collect()}
    wrong = [i for i in range(600, 900) if found[i] != (i % 6 == 0)]
    assert len(wrong) <= 3
    again = {r.doc_id: r.toxic for r in toxicity.classify(docs.repartition(7), labels.repartition(5)).collect()}
    assert again == found
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not t for t in found.values())


def test_toxicity_odd_rows(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.classify(odd, labels).count() == odd.count()
    assert toxicity.drop_toxic(clashing, labels.limit(0)).count() == odd.count()
    assert {r.toxic for r in toxicity.classify(odd, labels.limit(0)).collect()} == {False}
    assert toxicity.classify(empty, labels).count() == 0
    assert toxicity.drop_toxic(empty, labels).columns == empty.columns


def test_training_rows_are_bounded(spark):
    """Repeated ids count as rows, equal rows once."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(40)] + [(2, "same")] * 40, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity._training_rows(docs, labels, 2).count() <= 2
    assert toxicity._training_rows(docs, labels, 100).count() == 41


def test_terms_of_a_fold_are_selected_without_it(spark):
    names = toxicity._places()
    counts = spark.createDataFrame([("held", 50, 0, 50, 50, 0, 0, 50, 0, 0), ("both", 30, 0, 30, 30, 0, 30, 30, 0, 30)], "term string, " + ", ".join(f"{c} bigint" for c in names))
    totals = dict(zip(names, [200, 0, 60] * 3))
    assert set(toxicity._select_terms(counts, totals, 1)) == {"held", "both"}
    assert toxicity._select_terms(counts, totals, 0) == ["both"]


def test_term_counts(spark):
    rows = [(f"alpha beta {i % 2}", [i % 2, 1], i % 3) for i in range(12)]
    found = {r.term: r.asDict() for r in toxicity._term_counts(spark.createDataFrame(rows, "text string, y array<int>, fold int").repartition(3)).collect()}
    assert found["^alpha$"] == {"term": "^alpha$"} | {f"{c}_{f}": n for f in range(3) for c, n in (("n", 4), ("pos0", 2), ("pos1", 4))}


def brute_probabilities(chain, text):
    """The chain, model by model, from terms counted one by one."""
    words = toxicity._WORDS.findall(text.lower())
    x = np.zeros(len(chain.terms))
    for term, i in chain.terms.items():
        x[i] = sum(term in {f"^{w}$", *(f"^{w}$"[a : a + k] for k in (4, 5, 6) for a in range(len(w) + 3 - k))} for w in words)
    row = [*np.log1p(x), *toxicity.shape_of(text, words, len(set(words)))]
    for w in chain.weights:
        row.append(1 / (1 + np.exp(-(np.dot(row, w[:-1]) + w[-1]))))
    return row[-len(chain.weights) :]


def test_toxicity_query_against_brute_force(spark, sf_dir, few):
    from corvane.llm.common import labels

    df, texts = few
    rows = op2_toxicity(spark, sf_dir)
    assert rows.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    rows = rows.collect()
    chain = toxicity.train_chain(df, labels(spark, sf_dir))
    assert len(rows) == 200 and len(chain.weights) == 2 and len(chain.weights[1]) == len(chain.weights[0]) + 1
    for r in rows[::4]:
        p = brute_probabilities(chain, texts[r.doc_id] or "")
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(p, abs=1e-6)
    assert all(r.toxic == (r.p_toxic >= chain.threshold) for r in rows)


def test_gradients():
    """One training step moves the loss down on a batch, and table lookups equal a direct convolution."""
    draw = np.random.default_rng(3)
    net = langid.ByteNet(["a", "b"])
    x = draw.integers(0, 256, (8, langid.WINDOW), dtype=np.uint8)
    for w, got in net._gathered(x):
        places = langid.WINDOW - w + 1
        direct = np.zeros((8, places, langid.FILTERS), np.float32)
        for j in range(w):
            direct += net.tables[w][j][x[:, j : j + places]]
        assert np.abs(direct - got).max() < 1e-5
    y = np.arange(8) % 2
    loss = lambda: -np.log(net.probabilities(x)[np.arange(8), y]).mean()
    before = loss()
    net.train(x, y, epochs=3)
    assert loss() < before


def test_windows_cover_every_place():
    for n in (0, 1, langid.WINDOW, langid.WINDOW + 1, langid.STRIDE * 3 + 5, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        windows = langid.windows_of(data)
        seen = {(k * langid.STRIDE + i) for k in range(len(windows)) for i in range(langid.WINDOW) if windows[k, i]}
        assert seen == set(range(n))
        wide = max(langid.WIDTHS)
        assert all(any(k * langid.STRIDE <= p and p + wide <= k * langid.STRIDE + langid.WINDOW for k in range(len(windows))) for p in range(max(0, n - wide + 1)))


def test_language_query(spark, sf_dir, few):
    df, texts = few
    truth = {r.doc_id: r.lang for r in df.collect()}
    rows = op10_language(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert r.lang_pred in {"und", *truth.values()}
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9


def test_language_query_against_brute_force(spark, few):
    """Every window of every text by direct convolution, filter by filter."""
    df, texts = few
    net = langid.train_net(df)
    rows = langid.predict(df, net).collect()
    for r in sorted(rows)[::5]:
        data = (texts[r.doc_id] or "").lower().encode()
        if r.lang_pred == "und":
            continue
        total, weight = np.zeros(len(net.languages)), 0.0
        for at in range(0, max(1, len(data) - langid.WINDOW + langid.STRIDE), langid.STRIDE):
            window = np.frombuffer(data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)
            pooled = np.concatenate([np.max([sum(net.tables[w][j][window[i + j]] for j in range(w)) for i in range(langid.WINDOW - w + 1)], axis=0) for w in langid.WIDTHS])
            z = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
            share = min(len(data) - at, langid.WINDOW) / langid.WINDOW
            total += share * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            weight += share
        assert r.score == pytest.approx(total.max() / weight, abs=1e-4) and r.lang_pred == net.languages[int(total.argmax())]


def test_repeated_rows_train_once(spark):
    df = spark.createDataFrame([(i, "aaa bbb" if i % 2 else "ccc ddd", "x" if i % 2 else "y") for i in (0, 2, 3, 5) for _ in range(30)], "doc_id bigint, text string, lang string")
    one, other = langid.train_net(df), langid.train_net(df.distinct())
    assert (one is None) == (other is None) and (one is None or np.array_equal(one.out, other.out))


def test_language_odd_rows(spark, odd, empty, clashing):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r, t in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), range(99)) if r.doc_id in (2, 3, 4)} == {"und"}
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert langid.identify(empty).count() == 0
    assert langid.identify(clashing).count() == odd.count()
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(none).collect()} == {("und", 0.0)}


def test_every_language_is_learned(spark, monkeypatch):
    from corvane.llm import langid

    monkeypatch.setattr(langid, "TRAIN_DOCS", 150, raising=False)
    rows = [(10 * k + i, f"words of language {k}", f"l{k:03}") for k in range(130) for i in range(10)]
    net = langid.train_net(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert net.languages == [f"l{k:03}" for k in range(130)]
