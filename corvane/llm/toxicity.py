"""Toxicity by a classifier chain over words and parts of words.

Categories are predicted one after another by logistic regression; each later model also sees the
probabilities of the earlier categories. In training these come from models that have not seen the row
(out-of-fold predictions), so that a later model does not learn to trust an earlier one more than new
texts allow. The categories are what the label table has: low_quality (quality = 0), then toxic.

Features of a text: for each selected term the logarithm of one plus the number of its words that have the
term (a term is a word or a run of 4 to 6 letters of one, word ends marked), and the shares of
capitals, digits and signs, its length and how often its words repeat. Terms are selected by the z-score of their
document frequencies in positive against other training rows; models of a fold use terms selected without that fold's rows.

Training uses at most MAX_TRAIN labelled rows, chosen by a hash of the id and the text; everything is scored.

Edge cases: a null text counts as empty; labels that are null in any category, and labels without a document, train nothing; of
repeated label rows the largest values hold; without any positive or negative training row a category's
probability is its share in training (0 without labels); all columns and rows are kept by score_column.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import reliable_checkpoint
from .common import bound_batches, text_or_empty

CATEGORIES = ("low_quality", "toxic")
MAX_TRAIN = 8000
MAX_TERMS = 1024
MIN_DOCS = 8
MIN_Z = 4.0
FOLDS = 3
RIDGE = 1e-3
STEPS = 250
THRESHOLD = 0.5
MAX_WORDS = 40_000

_WORDS = re.compile(r"[^\W\d_]+")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'")
SHAPES = 6


def terms_of(word: str) -> set[str]:
    marked = f"^{word}$"
    n = len(marked)
    return {marked, *(marked[i : i + k] for k in (4, 5, 6) for i in range(n - k + 1))}


def shape_of(text: str, words: list[str], distinct: int) -> list[float]:
    data = text.encode()
    n = max(1, len(data))
    share = lambda drop: 1 - len(data.translate(None, drop)) / n
    return [share(_UPPER), share(_DIGITS), share(_SIGNS), np.log1p(len(words)) / 10, distinct / max(1, len(words)), data.count(b"\n") / n * 10]


@dataclass
class Chain:
    """One linear model for each category over terms, shapes and earlier categories' probabilities."""

    categories: tuple[str, ...]
    terms: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = THRESHOLD

    def __post_init__(self):
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.seen = {}

    def features(self, text: str) -> tuple[dict[int, int], list[float]]:
        words = _WORDS.findall(text.lower())
        distinct = set(words)
        new = distinct.difference(self.seen)
        if new:
            if len(self.seen) + len(new) > MAX_WORDS:
                self.seen.clear()
                new = distinct
            index = self.terms
            for word in new:
                self.seen[word] = tuple(index[t] for t in terms_of(word) if t in index)
        counts: dict[int, int] = {}
        marked = [w for w in distinct if self.seen[w]]
        if marked:
            times = Counter(words)
            for word in marked:
                for i in self.seen[word]:
                    counts[i] = counts.get(i, 0) + times[word]
        return counts, shape_of(text, words, len(distinct))

    def probabilities(self, text: str) -> list[float]:
        counts, shape = self.features(text)
        at, values = list(counts), np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        out: list[float] = []
        for w in self.weights:
            n = len(self.terms)
            z = w[n + SHAPES + len(out)] + float(values @ w[at] if at else 0.0) + float(np.dot(shape, w[n : n + SHAPES])) + float(np.dot(out, w[n + SHAPES : n + SHAPES + len(out)]))
            out.append(round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights and, last, the bias, by accelerated gradient steps from zero."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    n, d = x1.shape
    if not n or y.min() == y.max():
        w = np.zeros(d)
        share = float(y.mean()) if n else 0.0
        w[-1] = np.log((share + 1e-9) / (1 - share + 1e-9))
        return w
    # Single precision halves the traffic over the matrix; the ridge keeps the problem well conditioned.
    x1, y = x1.astype(np.float32, copy=False), y.astype(np.float32)
    v = np.ones(d, np.float32)
    for _ in range(20):
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(np.linalg.norm(x1 @ v) ** 2) / n * 1.05 + ridge)
    w = last = np.zeros(d, np.float32)
    shrink = np.full(d, ridge, np.float32)
    shrink[-1] = 0
    for t in range(steps):
        ahead = w + np.float32(t / (t + 3)) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        last, w = w, ahead - np.float32(rate) * (x1.T @ (p - y) / np.float32(n) + shrink * ahead)
    return w.astype(np.float64)


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability, in steps of 0.05, above which F1 is best; the middle one of equally good ones."""
    grid = np.round(np.arange(0.1, 0.95, 0.05), 2)
    score = [2 * int(((p >= g) & y).sum()) / max(1, int((p >= g).sum() + y.sum())) for g in grid]
    best = [g for g, s in zip(grid, score) if s == max(score)]
    return float(best[len(best) // 2]) if y.any() else THRESHOLD


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, columns: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Each category's weights, and out-of-fold probabilities. x: rows of terms and shapes; y: a column for each
    category; folds: each row's fold number; columns: those of x that each fold's models see, and last those of the
    final models (all by default)."""
    columns = columns or [np.arange(x.shape[1])] * (FOLDS + 1)
    out, known = [], np.zeros((len(x), 0), x.dtype)
    for c in range(y.shape[1]):
        target = y[:, c].astype(np.float64)
        out.append(fit_logistic(np.concatenate([x[:, columns[-1]], known], axis=1), target))
        unseen = np.zeros(len(x))
        for f in range(FOLDS):
            held = folds == f
            if held.any() and not held.all():
                seen = np.concatenate([x[:, columns[f]], known], axis=1)
                unseen[held] = _predict(seen[held], fit_logistic(seen[~held], target[~held]))
        known = np.concatenate([known, unseen[:, None].astype(x.dtype)], axis=1)
    return out, known


def _training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(id, text, y, fold): at most max_train rows, also where ids repeat; of equal rows one."""
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    y = F.array(*[categories[c].cast("int") for c in CATEGORIES])
    chosen = known.select(F.col("doc_id").alias("key"), y.alias("y")).orderBy(F.xxhash64("key"), "key").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_or_empty().alias("text"))
    # At most max_train rows of an id and two flags are broadcast.
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("key")).select("id", "text", "y").distinct()
    return rows.orderBy(F.xxhash64("id", "text"), "id").limit(max_train).withColumn("fold", F.pmod(F.xxhash64(F.col("id") + 1), F.lit(FOLDS)).cast("int"))


def _places() -> list[str]:
    """Names of a term's counts: of each fold its rows and its positive rows of each category."""
    return [f"{c}_{f}" for f in range(FOLDS) for c in ("n", *[f"pos{i}" for i in range(len(CATEGORIES))])]


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, n_<fold>, pos<category>_<fold>, ...): in how many rows, and in how many positive ones, a term occurs; without
    terms in fewer than MIN_DOCS rows, which are most of all."""
    width = len(CATEGORIES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out():
            items = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in items], pa.string()), *[pa.array([c[i] for _, c in items], pa.int64()) for i in range(width * FOLDS)]], names=["term", *_places()])

        for batch in batches:
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns)):
                for term in set().union(*map(terms_of, set(_WORDS.findall(text.lower())))):
                    c = counts.setdefault(term, [0] * (width * FOLDS))
                    c[fold * width] += 1
                    for i, v in enumerate(y):
                        c[fold * width + i + 1] += v
                if len(counts) > MAX_WORDS:
                    yield out()
        yield out()

    counted = rows.select("text", "y", "fold").mapInArrow(run, "term string, " + ", ".join(f"{c} bigint" for c in _places()))
    counted = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in _places()])
    return counted.where(sum((F.col(f"n_{f}") for f in range(FOLDS)), F.lit(0)) >= MIN_DOCS)


def _select_terms(counts: DataFrame, totals: dict[str, int], held: int | None) -> list[str]:
    """Terms with the highest z-scores of any category in the rows outside the held fold. totals: all rows' counts, named
    like those of terms."""
    folds = [f for f in range(FOLDS) if f != held]
    of = lambda c: sum((F.col(f"{c}_{f}") for f in folds), F.lit(0))
    total = lambda c: sum(totals[f"{c}_{f}"] for f in folds)
    rows, n, score = total("n"), of("n"), F.lit(0.0)
    for i in range(len(CATEGORIES)):
        positive = total(f"pos{i}")
        if 0 < positive < rows:
            pos = of(f"pos{i}")
            mean = n / rows
            z = (pos / positive - (n - pos) / (rows - positive)) / F.sqrt(mean * (1 - mean) * (1 / positive + 1 / (rows - positive)) + 1e-12)
            score = F.greatest(score, z)
    best = counts.where(n >= MIN_DOCS).select("term", score.alias("z")).where(F.col("z") >= MIN_Z)
    return [r.term for r in best.orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect()]


def train_chain(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain:
    bound_batches(docs.sparkSession)
    rows = reliable_checkpoint(_training_rows(docs, labels, max_train))
    by_fold = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.get("y", i)).alias(f"pos{i}") for i in range(len(CATEGORIES))]).collect()}
    totals = {c: by_fold[int(f)][name] if int(f) in by_fold else 0 for c in _places() for name, f in [c.rsplit("_", 1)]}
    counts = reliable_checkpoint(_term_counts(rows))
    chosen = [_select_terms(counts, totals, f) for f in (*range(FOLDS), None)]
    # The final models' terms come first; the others are only needed by the folds' models.
    every = {t: i for i, t in enumerate(dict.fromkeys(chosen[-1] + [t for some in chosen for t in some]))}
    wide, chain = Chain(CATEGORIES, every), Chain(CATEGORIES, {t: i for i, t in enumerate(chosen[-1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([list(c) for c, _ in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64())), batch.column("y"), batch.column("fold")], names=["id", "at", "counts", "shape", "y", "fold"])

    table = rows.mapInArrow(run, "id bigint, at array<int>, counts array<int>, shape array<double>, y array<int>, fold int").toPandas()
    # Ties of repeated ids are broken by content, so that the fit does not depend on the order of partitions.
    table["tie"] = [(tuple(sorted(zip(a, c))), tuple(s)) for a, c, s in zip(table["at"], table["counts"], table["shape"])]
    table = table.sort_values(["id", "tie"]).reset_index(drop=True)
    x = np.zeros((len(table), len(every) + SHAPES), np.float32)
    for r, (at, counts_, shape) in enumerate(zip(table["at"], table["counts"], table["shape"])):
        x[r, np.asarray(at, np.int64)] = np.log1p(np.asarray(counts_, np.float64))
        x[r, len(every) :] = shape
    y = np.array([list(v) for v in table["y"]], np.int8).reshape(len(table), len(CATEGORIES))
    columns = [np.array([every[t] for t in some] + list(range(len(every), len(every) + SHAPES)), np.int64) for some in chosen]
    chain.weights, unseen = fit_chain(x, y, table["fold"].to_numpy(np.int64), columns)
    chain.threshold = best_threshold(unseen[:, -1], y[:, -1] == 1)
    return chain


def score_column(chain: Chain, text_col: str = "text") -> Column:
    """array<double>: the probability of each category, in order."""

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([chain.probabilities(t.as_py()) for t in texts], pa.list_(pa.float64()))
            pa.default_memory_pool().release_unused()

    return score(text_or_empty(text_col))


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float | None = None) -> DataFrame:
    """(doc_id, p_<category> ..., toxic) for each row; the threshold is the one with the best F1 over
    out-of-fold predictions unless given."""
    chain = train_chain(docs, labels, max_train)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score_column(chain).alias("p"))
    scored = scored.select("doc_id", *[F.get("p", i).alias(f"p_{c}") for i, c in enumerate(CATEGORIES)])
    return scored.withColumn("toxic", F.col("p_toxic") >= (chain.threshold if threshold is None else threshold))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float | None = None) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    chain = train_chain(docs, labels, max_train)
    # The document travels as one value, so that none of its columns can be taken for the score.
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score_column(chain).alias("p"))
    return scored.where(F.get("p", CATEGORIES.index("toxic")) < (chain.threshold if threshold is None else threshold)).select("row.*")
