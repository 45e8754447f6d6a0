"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources in code point order (null last) take the weights in turn and share all words by them; no source
gets more than max_copies times its own words, and the excess goes to the others by weight, until none is above.
Every document of a source gets floor(target / size) certain whole copies. What is left of the target is drawn as one
more copy of some documents, with odds that differ by document: inclusion probabilities are proportional to a document's words
(p = c * size; where that reaches 1 the copy is certain, and c is solved anew for the others), with c such that the
expected words are just what is left. The number of documents drawn is fixed before any draw: the sum of the p,
rounded. Documents are ranked by random odds u/(1-u), u from a hash of the id, divided by their inclusion odds p/(1-p),
and that many of the lowest ranks are taken (Pareto order sampling). A sample of fixed number varies in words, so some of
the documents just inside the cut (NEAR at most) then trade places with as many of those just outside of it: as many pairs of
smallest with largest as come nearest to the target, then at most one pair more. The number drawn stays what it was.

No source is ever sorted as a whole: ranks fall into BINS bins by value, documents are counted by bin, and
only rows of the bin that holds the cut are numbered. Sizes are counted before they are ordered, and sources
are numbered and shared out without bringing them into one task.

Edge cases: a null text has no words and is never drawn; a null id draws from its text's digest; rows that share id,
source and size share rank and fate (so the number drawn may be exceeded by such copies at the cut); equal draws of
different ids go by id; a source without words has target 0; empty tables give empty results; a document
travels as one value beside the columns used here, so that none of its columns can clash with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import reliable_checkpoint
from .common import WORD, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 42
BINS = 4096
#: So many documents on either side of the cut may trade places, but of few draws only one in NEAR_SHARE (two at least).
NEAR = 24
NEAR_SHARE = 2
#: Facts of sources are broadcast up to so many bytes; beyond it the join is salted.
BROADCAST_BYTES = 16 << 20
#: What a source's facts take besides its name.
FACT_BYTES = 256
SALTS = 32


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = WEIGHTS
    max_copies: int = MAX_COPIES
    seed: int = SEED


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def draw(id_col: str, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the id (from the text where the id is null)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(text))))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 48))


def with_draws(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(row, id, source, size, u): each document as one value, and what the mix depends on."""
    text = text_or_empty(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), draw(id_col, text, params.seed).alias("u"))


def _numbered(sources: DataFrame) -> DataFrame:
    """The sources and, as place, their numbers from 0 in code point order, null last: counted by range."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = reliable_checkpoint(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("within")))
    before, offsets = 0, {}
    for r in sorted(ranged.groupBy("part").count().collect()):
        offsets[r["part"]] = before
        before += r["count"]
    first = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.col("part")) if offsets else F.lit(0)
    return ranged.withColumn("place", first + F.col("within")).drop("part", "within")


def source_targets(rows: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(source, source_size, target): one row for each source."""
    sources = _numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, params.weights)), (F.pmod("place", F.lit(len(params.weights))) + 1).cast("int")).cast("double")
    sources = reliable_checkpoint(sources.select("source", "source_size", weight.alias("w"), (F.col("source_size") * params.max_copies).cast("double").alias("cap")))
    # The share of one unit of weight rises as sources reach their caps, until no more of them do.
    level, settled = -1.0, None
    while True:
        free = F.col("cap") / F.col("w") > level
        found = sources.agg(F.sum(F.col("source_size").cast("decimal(38,0)")).alias("all"), F.sum(F.when(~free, F.col("cap").cast("decimal(38,0)"))).alias("capped"), F.sum(F.when(free, F.col("w"))).alias("w"), F.sum(F.when(free, 1).otherwise(0)).alias("n")).first()
        if not found.n or found.n == settled:
            break
        settled, level = found.n, (float(found["all"]) - float(found.capped or 0)) / found.w
    return sources.select("source", "source_size", F.round(F.least(F.col("cap"), F.col("w") * level), 6).alias("target"))


def _is_small(facts: DataFrame) -> bool:
    return facts.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("source", F.lit(""))) + FACT_BYTES), F.lit(0))).first()[0] <= BROADCAST_BYTES


def _attach(rows: DataFrame, facts: DataFrame, small: bool) -> DataFrame:
    """Rows with their source's facts; a hot source is spread over salts where facts are too large to broadcast."""
    facts = facts.withColumnRenamed("source", "key")
    if small:
        return rows.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("key")), "left").drop("key")
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("own_salt", F.floor(F.col("u") * 1e9).cast("bigint") % SALTS)
    return rows.join(salted, F.col("source").eqNullSafe(F.col("key")) & (F.col("own_salt") == F.col("salt")), "left").drop("key", "salt", "own_salt")


def _join_sources(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "key")
    return left.join(right, F.col("source").eqNullSafe(F.col("key")), "left").drop("key")


def _inclusion(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(source, rate, wanted): p is rate * size, at most 1; wanted is the fixed number of documents drawn."""
    sizes = _join_sources(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), facts.select("source", "left")).where("left > 0")
    big = lambda x: x.cast("decimal(38,0)")
    words, squares = big(F.col("n") * F.col("size")), big(F.col("n")) * big(F.col("size") * F.col("size"))
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    sizes = sizes.select("source", "size", "left", *[e.alias(f"{name}_{which}") for name, x in (("n", F.col("n")), ("w", words), ("s", squares)) for which, e in (("before", F.coalesce(F.sum(x).over(larger), F.lit(0))), ("all", F.sum(x).over(every)))])
    rate = (F.col("left") - F.col("w_before").cast("double")) / (F.col("s_all") - F.col("s_before")).cast("double")
    sizes = sizes.withColumn("rate", rate).where(F.col("rate") * F.col("size") <= 1)
    wanted = F.round(F.col("n_before") + F.col("rate") * (F.col("w_all") - F.col("w_before")).cast("double")).cast("bigint")
    # All larger sizes are certain; the first size that need not be settles the rate.
    return sizes.groupBy("source").agg(F.max(F.struct("size", "rate", wanted.alias("wanted"))).alias("x")).select("source", "x.rate", "x.wanted")


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with q, random odds by inclusion odds: 0 where a copy is certain, null where there is none."""
    p = F.col("rate") * F.col("size")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    rows = rows.withColumn("q", F.when(p >= 1, 0.0).when(p > 0, odds))
    return rows.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))


def plan_mix(rows: DataFrame, params: MixParams = MixParams()) -> tuple[DataFrame, bool]:
    """What decides each row, by source, and whether it is small enough to broadcast. rows: (id, source, size, u)."""
    facts = source_targets(rows, params)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = facts.withColumn("whole", F.least(F.floor(ratio), F.lit(params.max_copies)).cast("bigint"))
    left = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    facts = reliable_checkpoint(facts.withColumn("left", F.when(F.col("whole") < params.max_copies, left).otherwise(0.0)))
    small = _is_small(facts)
    facts = reliable_checkpoint(_join_sources(facts, _inclusion(rows, facts)))

    ranked = _ranked(_attach(rows, facts, small)).where(F.col("q").isNotNull())
    bins = ranked.groupBy("source", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = bins.select("source", "bin", "n", "words", "wanted", F.sum("n").over(upto).alias("n_upto"), F.sum("words").over(upto).alias("words_upto"))
    cross = bins.where((F.col("n_upto") >= F.col("wanted")) & (F.col("wanted") > 0))
    cross = cross.groupBy("source").agg(F.min(F.struct("bin", (F.col("n_upto") - F.col("n")).alias("n"), (F.col("words_upto") - F.col("words")).alias("words"))).alias("c"))
    facts = reliable_checkpoint(_join_sources(facts, cross.select("source", F.col("c.bin").alias("cut_bin"), F.col("c.n").alias("n_before"), F.col("c.words").alias("words_before"))))

    edge = _ranked(_attach(rows, facts, small)).where(F.col("bin") == F.col("cut_bin"))
    number = F.col("n_before") + F.row_number().over(Window.partitionBy("source").orderBy("q", "id"))
    edge = edge.withColumn("number", number).where(F.col("number") <= F.col("wanted"))
    edge = edge.groupBy("source").agg(F.max(F.struct("q", "id")).alias("last"), F.sum("size").alias("words_edge"))
    facts = _join_sources(facts, edge)
    missing = F.when(F.col("last").isNotNull(), F.col("left") - F.col("words_before") - F.col("words_edge")).otherwise(0.0)
    facts = reliable_checkpoint(facts.withColumn("missing", missing).drop("n_before", "words_before", "words_edge"))

    ranked = _ranked(_attach(rows, facts, small)).where("q > 0 and last is not null")
    near = _join_sources(_nearest(ranked.where(_within()), True), _nearest(ranked.where(~_within()), False))
    return reliable_checkpoint(_join_sources(facts, _trades(near))), small


def _nearest(rows: DataFrame, taken: bool) -> DataFrame:
    """The NEAR rows of each source next to the cut on one side, by size; each task keeps as many before they are shuffled (the
    constant bound lets it)."""
    order = (F.desc("q"), F.desc("id")) if taken else (F.asc("q"), F.asc("id"))
    first = rows.withColumn("number", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where((F.col("number") <= NEAR) & (F.col("number") <= F.greatest(F.lit(2), F.ceil(F.col("wanted") / NEAR_SHARE))))
    listed = F.array_sort(F.collect_list(F.struct("size", "q", "id")))
    return first.groupBy("source").agg(listed.alias("inside"), F.first("missing").alias("missing")) if taken else first.groupBy("source").agg(listed.alias("outside"))


def _trades(near: DataFrame) -> DataFrame:
    """(source, trade): the documents (q, id) on either side of the cut that change places. near: (source, inside, outside,
    missing)."""
    mark = lambda x: F.struct(x["q"].alias("q"), x["id"].alias("id"))
    near = near.where("inside is not null and outside is not null")
    # Where words are missing, the smallest inside meet the largest outside; where there are too many, the other way about.
    near = near.select("source", "missing", F.when(F.col("missing") < 0, F.reverse("inside")).otherwise(F.col("inside")).alias("x"), F.when(F.col("missing") < 0, F.col("outside")).otherwise(F.reverse("outside")).alias("y"))
    near = near.withColumn("gains", F.transform(F.slice("x", F.lit(1), F.least(F.size("x"), F.size("y"))), lambda x, i: F.get("y", i)["size"] - x["size"]))
    total = lambda k: F.aggregate(F.slice("gains", F.lit(1), k), F.lit(0).cast("bigint"), lambda t, g: t + g)
    pairs = F.transform(F.sequence(F.lit(0), F.size("gains")), lambda k: F.struct(F.abs(F.col("missing") - total(k)).alias("gap"), k.alias("k"), total(k).alias("words")))
    near = near.withColumn("many", F.array_min(pairs))
    k, missing = F.col("many.k"), F.col("missing") - F.col("many.words")
    rest = lambda side: F.slice(side, k + 1, F.greatest(F.size(side) - k, F.lit(0)))
    one = F.flatten(F.transform(rest("x"), lambda x: F.transform(rest("y"), lambda y: F.struct(F.abs(missing - (y["size"] - x["size"])).alias("gap"), F.array(mark(x), mark(y)).alias("pair")))))
    best = F.array_min(one)
    pair = F.when(best["gap"] < F.abs(missing), best["pair"]).otherwise(F.array().cast("array<struct<q:double,id:bigint>>"))
    first = lambda side: F.transform(F.slice(side, F.lit(1), k), mark)
    return near.select("source", F.concat(first("x"), first("y"), pair).alias("trade"))


def _order() -> Column:
    return F.struct("q", "id")


def _within() -> Column:
    return F.coalesce((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (_order() <= F.col("last"))), F.lit(False))


def apply_mix(rows: DataFrame, facts: DataFrame, small: bool) -> DataFrame:
    """The rows with source_size, target and how many copies of each the mix takes."""
    kept = _ranked(_attach(rows, facts, small))
    more = _within() != F.coalesce(F.array_contains("trade", _order()), F.lit(False))
    kept = kept.withColumn("copies", F.col("whole") + more.cast("bigint"))
    return kept.select(*rows.columns, "source_size", "target", "copies")


def mix_documents(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents, each row as many times as the mix takes it, with the columns they came with."""
    drawn = with_draws(docs, params, id_col, source_col, text_col)
    narrow = reliable_checkpoint(drawn.drop("row"))
    facts, small = plan_mix(narrow, params)
    mixed = apply_mix(drawn, facts, small).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
