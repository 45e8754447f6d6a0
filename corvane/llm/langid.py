"""Language identification by a convolutional network over bytes, written and trained in numpy.

Lower-case UTF-8 bytes are read in windows of WINDOW bytes that overlap by the widest filter less one, so
that every filter sees every place of a text. For each width there are FILTERS filters over one-hot bytes;
a window's features are each filter's largest response (rectified), and softmax weights turn them
into language probabilities. A document's probabilities are the mean over its windows, weighted by their bytes.
Training back-propagates through the pooled places only; the filters are tables from byte to response, so
applying them is gathering rows, two bytes at once.

Training rows: documents with a language and a letter whose CRC-32 of the id as text is not 1 modulo 3; of
each language about DOCS_PER_LANG documents by a hash of id and text, repeated rows once (fewer where there are so many languages that all would have
more than TRAIN_DOCS, but one at least), and of those all windows. A long document's windows weigh together as much
as four of a short one's. Only text and lang are read. All documents are predicted, over whole texts.

Edge cases: texts that are null or have no letter are 'und' with score 0, and so is everything when there
is nothing to learn from; a null id is neither held out nor trained on; equal texts get equal results; repeated rows and
very long texts are read in blocks of windows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
STRIDE = WINDOW - max(WIDTHS) + 1
BLOCK = 512
#: The bounded sample: labelled documents of each language, and of all languages together.
DOCS_PER_LANG = 400
TRAIN_DOCS = 40_000
EPOCHS = 12
BATCH = 64
RATE = 0.01
SEED = 7
UNKNOWN = "und"


class ByteNet:
    """Filters as tables: tables[width] has shape (width, 256, FILTERS)."""

    def __init__(self, languages: list[str], seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: draw.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self._pairs = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def _gathered(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each width, responses of shape (windows, places, FILTERS), without bias."""
        if self._pairs is None:
            pair = lambda t, j: (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)
            self._pairs = {w: [pair(self.tables[w], j) for j in range(0, w - 1, 2)] for w in WIDTHS}
        codes = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        for w in WIDTHS:
            places = WINDOW - w + 1
            got = self._pairs[w][0].take(codes[:, :places], axis=0)
            for i, table in enumerate(self._pairs[w][1:], 1):
                got += table.take(codes[:, 2 * i : 2 * i + places], axis=0)
            if w % 2:
                got += self.tables[w][w - 1].take(windows[:, w - 1 : w - 1 + places], axis=0)
            yield w, got

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([got.max(axis=1) for _, got in self._gathered(windows)], axis=1)
        return self._softmax(np.maximum(pooled + self.bias, 0))

    def train(self, windows: np.ndarray, labels: np.ndarray, shares: np.ndarray | None = None, epochs: int = EPOCHS) -> None:
        """Adam on cross-entropy, weighted by each window's share so that languages count alike."""
        draw = np.random.default_rng(SEED + 1)
        shares = np.ones(len(labels)) if shares is None else shares
        weight = shares / np.maximum(np.bincount(labels, shares, minlength=len(self.languages)), 1e-12)[labels]
        weight = (weight / weight.mean()).astype(np.float32)
        params = [*(self.tables[w] for w in WIDTHS), self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = draw.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                x, y = windows[rows], labels[rows]
                places, pooled = {}, []
                for w in WIDTHS:
                    n = WINDOW - w + 1
                    got = sum(self.tables[w][j].take(x[:, j : j + n], axis=0) for j in range(w))
                    places[w] = got.argmax(axis=1)
                    pooled.append(np.take_along_axis(got, places[w][:, None, :], axis=1)[:, 0])
                raw = np.concatenate(pooled, axis=1) + self.bias
                hidden = np.maximum(raw, 0)
                slope = self._softmax(hidden)
                slope[np.arange(len(y)), y] -= 1
                slope *= (weight[rows] / len(y))[:, None]
                back = (slope @ self.out.T) * (raw > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    part, g = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(self.tables[w])
                    for j in range(w):
                        seen = np.take_along_axis(x, places[w] + j, axis=1)
                        np.add.at(g[j], (seen, np.broadcast_to(np.arange(FILTERS), seen.shape)), part)
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self._pairs = None


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with bytes 0."""
    n = max(1, -(-(len(data) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _data(text_col: str) -> Column:
    return F.lower(F.col(text_col).cast("string")).cast("binary")


def _has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def train_net(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> ByteNet | None:
    usable = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    usable = usable.where(F.col("lang").isNotNull() & (remainder("id") != 1))
    usable = usable.withColumn("u", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    found = usable.groupBy("lang").agg(F.count("*").alias("count"), F.min(F.when(_has_letter("text"), F.col("u"))).alias("least")).collect()
    if not found:
        return None
    each = max(1, min(docs_per_lang, TRAIN_DOCS // len(found)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"]), r["least"]) for r in found], "l string, share double, least double")
    # The first row by hash is always taken, so that no language is without one.
    usable = usable.join(F.broadcast(shares), F.col("lang") == F.col("l"))
    chosen = usable.where(((F.col("u") < F.col("share")) | (F.col("u") == F.col("least"))) & _has_letter("text")).withColumn("data", _data("text"))
    table = chosen.select("id", "lang", "data").distinct().toPandas()
    languages = sorted(set(table["lang"]))
    if not languages:
        return None
    places = {l: i for i, l in enumerate(languages)}
    texts = sorted(zip(table["id"].tolist(), table["lang"], map(bytes, table["data"])))
    parts = [windows_of(data) for _, _, data in texts]
    counts = np.array([len(p) for p in parts])
    net = ByteNet(languages)
    net.train(np.concatenate(parts), np.repeat([places[l] for _, l, _ in texts], counts), np.repeat(np.minimum(1.0, 4.0 / counts), counts))
    return net


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row."""
    bound_batches(docs.sparkSession)
    held = F.coalesce(remainder(id_col) == 1, F.lit(False))
    if net is None:
        return docs.select(F.col(id_col).cast("bigint").alias(id_col), held.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    narrow = docs.select(F.col(id_col).cast("bigint").alias(id_col), held.alias("held_out"), F.when(_has_letter(text_col), _data(text_col)).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sums = np.zeros((batch.num_rows, len(net.languages)))
            waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
            held_now = 0

            def flush():
                if waiting:
                    p = net.probabilities(np.concatenate([w for _, w, _ in waiting]))
                    rows = np.concatenate([np.full(len(w), i) for i, w, _ in waiting])
                    np.add.at(sums, rows, p * np.concatenate([s for _, _, s in waiting])[:, None])
                waiting.clear()

            for i in range(batch.num_rows):
                data = column[i].as_py()
                if data is None:
                    continue
                windows = windows_of(data)
                shares = np.full(len(windows), 1.0)
                shares[-1] = (len(data) - (len(windows) - 1) * STRIDE) / WINDOW
                for at in range(0, len(windows), BLOCK):
                    part = windows[at : at + BLOCK]
                    if held_now + len(part) > BLOCK:
                        flush()
                        held_now = 0
                    waiting.append((i, part, shares[at : at + BLOCK]))
                    held_now += len(part)
            flush()
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            names = [net.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
            score = np.where(total > 0, sums[np.arange(len(best)), best] / np.maximum(total, 1e-300), 0.0).round(6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return narrow.mapInArrow(run, f"{id_col} bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(docs, train_net(docs, id_col, text_col, lang_col), id_col, text_col)
