"""Document fingerprints by Merkle trees over sections and paragraphs, in DataFrame operations only.

A text falls into sections (each ends after a blank line), these into paragraphs (each ends after a line
break) and these into pieces: a sentence with its closing marks and white space, cut at PIECE code points.
Nothing is dropped, so the pieces joined are the text. A piece's hash is the SHA-256 of its text; the
hash of a paragraph, section or document is the SHA-256 of its children's hashes joined. Equal roots mean
equal trees; where roots differ, comparing children finds the branches that hold the edits: all sections and
paragraphs that differ are listed.

Likeness of two trees is the share of leaves in common: twice the number of distinct leaf hashes in both
over the sum of each one's number of distinct leaf hashes (1 for two empty texts).

Edge cases: a null text counts as empty, with no sections and the hash of nothing as root; null ids come
last in descending order; rows with equal ids go by a hash of the text, then the text; repeated rows each get a row and follow
each other; one row alone is followed by itself; an empty table gives an empty result; other columns are left out.
A text is one row of one task, so a text must fit in memory, but neither the corpus nor the rows of one id are ever
ordered in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

PIECE = 64
PARAGRAPHS = r"[^\n]*\n|[^\n]+"
PIECES = r"[^.!?]{1,%d}[.!?]*\s*|[.!?]+\s*" % PIECE
#: Rows that a run of neighbouring rows should hold while that makes at most MAX_RUNS of them (their bounds are known to
#: the driver); beyond that runs grow with the rows.
RUN_ROWS = 1000
MAX_RUNS = 1 << 16
#: An id with more rows than so many runs hold is split by the hash of its texts.
HOT_RUNS = 4


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def leaf_tree(text: Column) -> Column:
    """Leaf hashes by section and paragraph: array<array<array<string>>>."""
    sections = F.when(F.contains(text, F.lit("\n\n")), F.split(text, r"(?<=\n\n)")).otherwise(F.array(text))
    sections = F.filter(sections, lambda s: s != "")
    return F.transform(sections, lambda s: F.transform(_all(s, PARAGRAPHS), lambda p: F.transform(_all(p, PIECES), lambda x: F.sha2(x, 256))))


def leaves_only(text: Column) -> Column:
    """Distinct leaf hashes of a text."""
    return F.array_distinct(F.flatten(F.flatten(leaf_tree(text))))


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def with_tree(rows: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """All columns and <prefix>leaves (distinct), <prefix>paragraphs (hashes in order), <prefix>sections, <prefix>root.

    Each level is a projection of its own, so that no level is computed twice."""
    rows = rows.withColumn(f"{prefix}tree", leaf_tree(F.col(text_col)))
    rows = rows.withColumns({f"{prefix}leaves": F.array_distinct(F.flatten(F.flatten(f"{prefix}tree"))), f"{prefix}nodes": F.transform(f"{prefix}tree", lambda s: F.transform(s, _joined))}).drop(f"{prefix}tree")
    rows = rows.withColumns({f"{prefix}paragraphs": F.flatten(f"{prefix}nodes"), f"{prefix}sections": F.transform(f"{prefix}nodes", _joined)}).drop(f"{prefix}nodes")
    return rows.withColumn(f"{prefix}root", _joined(F.col(f"{prefix}sections")))


def likeness(a: str, b: str) -> Column:
    """Of two columns of distinct leaf hashes."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def differences(a: str, b: str) -> Column:
    """Indices from 0 of all places where two hash arrays differ."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.filter(F.transform(differ, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_sections, n_paragraphs, fingerprint) for each row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text_col).alias("t"))
    rows = with_tree(rows, "t", "")
    return rows.select(id_col, F.char_length("t").cast("bigint").alias("n_chars"), F.size("sections").alias("n_sections"), F.size("paragraphs").alias("n_paragraphs"), F.col("root").alias("fingerprint"))


@dataclass
class Runs:
    """How rows in order (ids descending, null last, then by hash) fall into runs. tops: the largest id of each
    range of ids, ascending; parts: into how many runs each range is cut by hash, and last the rows without id."""

    tops: list[int]
    parts: list[int]
    hot_texts: list[tuple[int | None, int, int]]

    @property
    def bases(self) -> list[int]:
        """The first run of each range; the range of the largest ids comes first, rows without id last."""
        ends = list(accumulate([*reversed(self.parts[:-1]), self.parts[-1]]))
        starts = [0, *ends[:-1]]
        return [*reversed(starts[:-1]), starts[-1]]

    def place(self, i: str, h: str) -> Column:
        """The run of a row. Equal rows of an id and text that are too many for a run are dealt out to runs past all others."""
        spot = _range_of(F.col(i), self.tops) if self.tops else F.lit(0)
        spot = F.when(F.col(i).isNull(), len(self.tops)).otherwise(spot)
        parts = F.get(F.lit(self.parts), spot)
        part = F.when(parts > 1, F.least(F.floor((F.col(h) / float(1 << 64) + 0.5) * parts).cast("int"), parts - 1)).otherwise(0)
        run = F.get(F.lit(self.bases), spot) + part
        for one, text, parts_ in self.hot_texts:
            salt = F.pmod(F.monotonically_increasing_id(), F.lit(parts_)).cast("int")
            run = F.when(F.col(i).eqNullSafe(F.lit(one).cast("bigint")) & (F.col(h) == text) & (salt > 0), sum(self.parts) + salt).otherwise(run)
        return run


def plan_runs(keys: DataFrame) -> Runs:
    """keys: (i, h) of all rows."""
    n = keys.count()
    each = max(RUN_ROWS, math.ceil(n / MAX_RUNS))
    # More rows than HOT_RUNS runs hold: at most MAX_RUNS / HOT_RUNS ids can have them, and as many pairs of id and text.
    hot = {r.i: r.c for r in keys.groupBy("i").agg(F.count("*").alias("c")).where(F.col("c") > HOT_RUNS * each).collect()}
    texts = []
    if hot:
        mine = keys.where(F.col("i").isin([i for i in hot if i is not None]) | (F.col("i").isNull() & F.lit(None in hot)))
        texts = [(r.i, r.h, math.ceil(r.c / each)) for r in mine.groupBy("i", "h").agg(F.count("*").alias("c")).where(F.col("c") > HOT_RUNS * each).collect()]
    runs = min(MAX_RUNS, max(1, math.ceil(n / each)))
    found = keys.where("i is not null").agg(F.percentile_approx("i", [(k + 1) / runs for k in range(runs)], 10 * runs).alias("p"), F.max("i").alias("m")).first()
    tops = {*(found.p or []), *([] if found.m is None else [found.m])}
    # A hot id is a range of its own.
    tops = sorted(tops | {i for i in hot if i is not None} | {i - 1 for i in hot if i is not None and i > -(1 << 63)})
    parts = [math.ceil(hot[t] / each) if t in hot else 1 for t in tops] + [math.ceil(hot.get(None, 1) / each)]
    return Runs(tops, parts, texts)


def _range_of(value: Column, tops: list[int]) -> Column:
    """Index of the first top that is not below the value, by binary search."""
    table = F.lit(tops)

    def step(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        over = F.get(table, middle) >= value
        return F.struct(F.when(over, state["low"]).otherwise(middle + 1).alias("low"), F.when(over, middle).otherwise(state["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(tops) - 1).alias("high"))
    rounds = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(tops))) + 1)))
    return F.aggregate(rounds, start, step, lambda s: s["low"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, t, after): each row with the text of the next one by descending id, the first one's after the last.

    Rows fall into runs; a window orders each run, and a copy of the next run's first row stands at its end. Rows past
    all runs equal others of a run, and are followed by one of those."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), text_or_empty(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    runs = plan_runs(rows.select("i", "h"))
    rows = rows.withColumns({"run": runs.place("i", "h"), "down": F.bitwise_not("i")})
    last = sum(runs.parts)
    firsts = sorted((r.run, r.f.down, r.f.h) for r in rows.where(F.col("run") < last).groupBy("run").agg(F.min(F.struct("down", "h")).alias("f")).collect())
    # One row for each run: at most some MAX_RUNS and twice as many parts of hot ids.
    table = [(run, down, h, firsts[k - 1][0]) for k, (run, down, h) in enumerate(firsts)]
    table = docs.sparkSession.createDataFrame(table, "run_ int, down_ bigint, h_ bigint, before int")
    met = (F.col("run") == F.col("run_")) & F.col("down").eqNullSafe(F.col("down_")) & (F.col("h") == F.col("h_"))
    rows = rows.join(F.broadcast(table), met, "left")
    own = F.struct(F.col("run").alias("run"), F.lit(0).alias("copy"))
    places = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("run"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    rows = rows.select("i", "t", "h", "down", F.explode(places).alias("x")).select("i", "t", "h", "down", "x.run", "x.copy")
    order = Window.partitionBy("run").orderBy("copy", F.col("down").asc_nulls_last(), "h", "t")
    after = F.when(F.col("run") >= last, F.col("t")).otherwise(F.lead("t").over(order))
    return rows.withColumn("after", after).where("copy = 0").select("i", "t", "after")


def edited_text(text: Column, after: Column) -> Column:
    """The last third of a text (rounded down) replaced by as much of the other text's start."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(after, F.lit(1), cut))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the module's text."""
    rows = with_next(docs, id_col, text_col).withColumn("e", edited_text(F.col("t"), F.col("after")))
    rows = with_tree(with_tree(rows, "t", "own_"), "e", "edit_").withColumn("after_leaves", leaves_only(F.col("after")))
    return rows.select(
        F.col("i").alias(id_col),
        F.char_length("t").cast("bigint").alias("n_chars"),
        F.sha2(F.col("e"), 256).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"),
        F.col("edit_root").alias("edited_fingerprint"),
        likeness("own_leaves", "edit_leaves").alias("near_edited"),
        likeness("own_leaves", "after_leaves").alias("near_next"),
        F.size("own_paragraphs").alias("n_paragraphs"),
        F.size("own_leaves").alias("n_leaves"),
        F.array_join(differences("own_sections", "edit_sections"), ",").alias("edited_sections"),
        F.array_join(differences("own_paragraphs", "edit_paragraphs"), ",").alias("edited_paragraphs"),
    )
