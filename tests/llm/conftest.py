from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

ODD = [
    (1, "The quick brown fox jumps over the lazy dog, twice in a row.", "en", "a", 60),
    (1, "The quick brown fox jumps over the lazy dog, twice in a row.", "en", "a", 60),
    (2, None, "en", "b", None),
    (3, "", None, "b", 0),
    (4, " \n\t ", "de", None, 4),
    (None, "no id at all here, but a text", "en", "a", 29),
    (None, None, None, None, None),
    (5, "émile écrit à zoe@example.org… ça va? +1 (555) 010-9999 <|endoftext|>", "fr", "c", 69),
    (5, "same id, other text", "en", "c", 19),
    (7, "word " * 30_000, "en", "a", 150_000),
    (8, "x" * 40_000, "en", "a", 40_000),
    (9, "Licensed under the Apache License, Version 2.0.\n\nTail.\nLine", "en", "d", 59),
    (-3, "negative id 10.0.0.1", "en", "d", 20),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like columns that operators make."""
    from pyspark.sql import functions as F

    names = ("text_hash", "fp", "size", "unit", "run", "copy", "media", "spans", "ids", "target", "source_size", "key", "e", "t", "i", "data", "score", "node", "root", "n_bytes", "x", "copies", "change", "near", "w", "level", "shard", "slot", "toxic", "p", "a", "b", "n", "k", "row", "h", "h_", "id", "u", "q", "bin", "goes", "again", "stays", "__i", "__h", "__p", "__id", "__size", "__th", "__source")
    return odd.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def few(spark, sf_dir):
    """(doc_id, text, ...) of the small corpus, as a frame and as a dict of texts."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, {r.doc_id: r.text for r in df.collect()}
