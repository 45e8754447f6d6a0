"""Texts to vectors through a pluggable encoder, one Arrow batch at a time."""

from __future__ import annotations

import importlib
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An encoder takes a list of texts and returns a float32 matrix of one row for each.
Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed counts of hashed words. For tests only."""
    words = re.compile(r"\w+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for r, text in enumerate(texts):
            for word in words.findall(text.lower()):
                code = zlib.crc32(word.encode())
                out[r, code % dim] += 1 if code >> 31 else -1
        return out

    return encode


def sentence_model(name: str, device: str | None = None) -> Encoder:
    """A model of the sentence-transformers package, where that is installed: loaded once in each worker, on first use."""
    held: dict[str, object] = {}

    def encode(texts: list[str]) -> np.ndarray:
        if "model" not in held:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as error:
                raise RuntimeError("this encoder needs the package sentence-transformers") from error
            held["model"] = SentenceTransformer(name, device=device)
        return np.asarray(held["model"].encode(texts, convert_to_numpy=True, show_progress_bar=False), np.float32)

    return encode


def encoder_of(spec: str, dim: int = 384) -> Encoder:
    """hash, or module:function (called without arguments for an encoder), or else the name or path of a sentence model."""
    if spec == "hash":
        return hashed_words(dim)
    if ":" in spec and not os.path.exists(spec):
        module, _, maker = spec.partition(":")
        return getattr(importlib.import_module(module), maker)()
    return sentence_model(spec)


def encode_texts(texts: DataFrame, encoder: Encoder, batch_size: int = 128, normalize: bool = True, key: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, embedding array<float>) for each row; unit vectors unless told otherwise (zero stays
    zero)."""

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.fillna("").tolist()
            parts = [np.asarray(encoder(values[i : i + batch_size]), np.float32) for i in range(0, len(values), batch_size)]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            if normalize:
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = matrix / np.where(norms > 0, norms, 1)
            yield pd.Series(list(matrix))

    return texts.select(key, *keep, encoded(F.col(text_col)).alias("embedding"))
