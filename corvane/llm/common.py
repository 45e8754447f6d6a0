"""What the corpus operators share: table access and Arrow row mapping in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: An output batch is handed on once it holds this many bytes of text or media.
FLUSH_BYTES = 2 << 20
FLUSH_ROWS = 1024

#: Arrow batches to Python workers hold at most so many bytes: a session that allows more is set to it.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Long texts make batches of the usual 10,000 rows large in both the JVM and Python."""
    now = int("".join(c for c in spark.conf.get(_BATCH_KEY) if c.isdigit()))
    if now > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of the text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], tuple]], schema: str, weigh: int | None = None) -> DataFrame:
    """Apply a function of one row to every row, in Arrow batches.

    make() runs once per task and returns the function; weigh is the index of an output column whose
    length bounds the output batches, so that very long values do not pile up.
    """
    bound_batches(df.sparkSession)
    names = schema_names(schema)
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            columns = batch.columns
            out: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                row = one(tuple(c[i].as_py() for c in columns))
                out.append(row)
                if weigh is not None:
                    held += len(row[weigh] or b"")
                if held >= FLUSH_BYTES or len(out) >= FLUSH_ROWS:
                    yield _batch(out, names, target)
                    out, held = [], 0
            if out:
                yield _batch(out, names, target)
            # Workers live on for other stages; what Arrow keeps for reuse goes back to the machine.
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), target.types)], names=names)


def schema_names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in _parts(schema)]


def _parts(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
