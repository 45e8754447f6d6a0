"""Near duplicates by SimHash: fingerprints, a byte-position inverted index with count filtering, components.

A fingerprint has 64 bits over the 3-word shingles of the text in lower case (A-Z only): a bit is set where
more than half of the shingles' XXH64 (seed 42) have it. Documents link at 3 or fewer differing bits.

Three differing bits touch at most three of the eight bytes, so linked fingerprints agree in at least five
byte positions: that is the guaranteed minimum of the count filter. Lists of single bytes would each hold
a 256th of all fingerprints, so the index is posted by combinations of positions. Of five agreeing
positions, three lie in the same half of the fingerprint: eight three-byte keys find every linked pair.
Lists of more than LIST fingerprints are posted again by two further bytes (five agreeing bytes in all, so
nothing is lost), and if they are still longer, by five of the eight 3-bit groups of the other three bytes;
the last lists cannot exceed 512 distinct fingerprints. Pairs within a list are tallied by agreeing bytes, those
below five are dropped, the rest are verified by their differing bits, and only a spanning forest of the
list's links is handed on, so that a dense group costs rows in proportion to its members.

keep_one also links texts whose sets of 5-word shingles have a Jaccard similarity of at least SIMILARITY.
Two sets of that similarity share one of the first prefix_length members of each in any common order
of all shingles, so an index of those members finds every pair; shingles that are frequent in a sample come last in
the order, the others by their hash. How many prefix members a pair shares bounds its similarity from above;
the pairs that this leaves are verified on their texts. Members of a list
meet its least node first; then all pairs of a list that are not joined by then are compared.

Components come from alternating large-star and small-star steps over the links of distinct fingerprints.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; one or two words are
one shingle; a null id takes part, but a component's id is the smallest id that is not null (null if there
is none); repeated rows each get a row; an empty table gives an empty result; very long texts are hashed in
blocks of shingles; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import default_size, reliable_checkpoint
from .common import bound_batches, map_rows, text_bytes

SEED = 42
SHINGLE = 3
MAX_BITS = 3
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
BLOCK = 1 << 15
#: Lists of up to so many fingerprints are compared at once; longer ones are posted by more bytes.
LIST = 64
MAX_ROUNDS = 60

#: keep_one's wording: shingle length and similarity.
WORDS = 5
SIMILARITY = 0.8
#: Shingles that so many of a sample of so many texts have come last in prefixes, at most so many of them.
SAMPLE = 8_000
COMMON = 8
MAX_COMMON = 500_000
#: Longer posting lists are compared in parts of so many members.
LIST_PART = 2_000
#: Sides of joins are broadcast up to so many bytes; beyond it both sides are shuffled.
BROADCAST_BYTES = 48 << 20
#: Bytes that a row of a broadcast side takes: with a long key (72 and 84 were measured), with a text's digest (171 and 176).
KEY_ROW = 88
DIGEST_ROW = 176


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes."""
    # bytes.lower and bytes.split know only A-Z and the six ASCII white space characters.
    words = text.lower().split()
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    digest, join = xxhash.xxh64_digest, b" ".join
    counts, total = np.zeros(64, np.int64), 0
    while block := [digest(join(p), seed) for p in islice(parts, BLOCK)]:
        bits = np.unpackbits(np.frombuffer(b"".join(block), np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp) for each row; fp is the fingerprint's 64 bits as a signed long."""

    def make():
        def one(row):
            fp = fingerprint(row[2], shingle)
            return row[0], row[1], fp - (1 << 64) if fp >> 63 else fp

        return one

    data = text_bytes(text_col)
    narrow = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.xxhash64(data).alias("text_hash"), data.alias("text"))
    return map_rows(narrow, make, f"{id_col} bigint, text_hash bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
FIVES = list(combinations(range(BYTES), MIN_SHARED))


def _five_masks(triple: int) -> list[int]:
    return [i for i, five in enumerate(FIVES) if set(TRIPLES[triple]) <= set(five)]


def _group_masks(five: int) -> list[int]:
    """Masks of five of the eight 3-bit groups in the three bytes outside a five-byte key."""
    free = [8 * p + b for p in range(BYTES) if p not in FIVES[five] for b in range(8)]
    groups = [sum(1 << b for b in free[i : i + 3]) for i in range(0, 24, 3)]
    return [_byte_mask(FIVES[five]) | sum(g) for g in combinations(groups, MIN_SHARED)]


def _posted(rows: DataFrame, keys: Column) -> DataFrame:
    """(fp, k, key) for each key of each fingerprint; k tells key kinds apart."""
    return rows.select("fp", F.explode(keys).alias("x")).select("fp", F.col("x.k").alias("k"), F.col("x.key").alias("key"))


def _key(k: int, mask: int) -> Column:
    return F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))


def _by_kind(options: list[Column]) -> Column:
    """The option of this row's k."""
    chosen = F.when(F.col("k") == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        chosen = chosen.when(F.col("k") == i, option)
    return chosen


def _lists(posted: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Lists of two to so many fingerprints, and the postings of longer ones."""
    counts = posted.groupBy("k", "key").count().where(F.col("count") > 1)
    counts = reliable_checkpoint(counts)
    short = counts if most is None else counts.where(F.col("count") <= most)
    pick = lambda which: posted.join(which.select(F.col("k").alias("k_"), F.col("key").alias("key_")), (F.col("k") == F.col("k_")) & (F.col("key") == F.col("key_")), "left_semi")
    lists = pick(short).groupBy("k", "key").agg(F.collect_set("fp").alias("fps")).select("fps")
    if most is None or counts.where(F.col("count") > most).isEmpty():
        return lists, None
    return lists, pick(counts.where(F.col("count") > most))


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links within one list, after the count filter."""
    fps = np.unique(fps)
    n = len(fps)
    raw = fps.view(np.uint8).reshape(n, BYTES)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(n - 1):
        shared = (raw[i + 1 :] == raw[i]).sum(axis=1)
        likely = np.flatnonzero(shared >= BYTES - max_bits)
        if len(likely):
            apart = np.bitwise_count((fps[i + 1 + likely] ^ fps[i]).view(np.uint64))
            for j in (i + 1 + likely[apart <= max_bits]).tolist():
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((int(fps[i]), int(fps[j])))
    return links


def _links_of(lists: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            found = [x for a, b in zip(offsets[:-1], offsets[1:]) for x in spanning_links(values[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return lists.mapInArrow(run, "a bigint, b bigint")


def links(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: links that connect all distinct fingerprints (column fp) that are reachable from each
    other by links of at most MAX_BITS bits."""
    posted = _posted(classes, F.array(*[_key(i, _byte_mask(t)) for i, t in enumerate(TRIPLES)]))
    lists, long = _lists(posted, LIST)
    found = [_links_of(lists)]
    if long is not None:
        keys = _by_kind([F.array(*[_key(i, _byte_mask(FIVES[i])) for i in _five_masks(t)]) for t in range(len(TRIPLES))])
        posted = reliable_checkpoint(_posted(long, keys).distinct())
        lists, long = _lists(posted, LIST)
        found.append(_links_of(lists))
        if long is not None:
            keys = _by_kind([F.array(*[_key(i * 64 + j, m) for j, m in enumerate(_group_masks(i))]) for i in range(len(FIVES))])
            posted = reliable_checkpoint(_posted(long, keys).distinct())
            lists, _ = _lists(posted, None)
            found.append(_links_of(lists))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    edges: (a, b). Large-star steps hang each node's larger neighbours on the smallest node it sees,
    small-star steps its smaller ones; they end when neither changes the edge set."""
    edges = default_size(reliable_checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()))
    sign = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        # Join on the small side of checkpointed rows, so that a hub's many rows can be split.
        large = both.where("b > a").join(reliable_checkpoint(least), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = reliable_checkpoint(large)
        least = reliable_checkpoint(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"))
        joined = large.join(least, F.col("a") == F.col("n"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        edges = default_size(reliable_checkpoint(small.distinct()))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp, root_fp, component_id) for each row; root_fp names the component."""
    rows = reliable_checkpoint(fingerprints(docs, id_col, text_col, shingle))
    classes = reliable_checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(classes))
    own = roots.join(classes, F.col("node") == F.col("fp")).select("node", "root", "least")
    # The root is a node of its component but has no row of its own.
    tops = roots.select("root").distinct().join(classes, F.col("root") == F.col("fp")).select(F.col("root").alias("node"), "root", "least")
    own = reliable_checkpoint(own.union(tops))
    ids = reliable_checkpoint(own.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"))
    named = own.join(ids, F.col("root") == F.col("r")).select("node", "root", "component_id")
    linked = F.col("node").isNotNull()
    named = classes.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("fp_"), F.when(linked, F.col("root")).otherwise(F.col("fp")).alias("root_fp"), F.when(linked, F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(reliable_checkpoint(named), F.col("fp") == F.col("fp_")).drop("fp_")


def shingle_hashes(text: bytes, shingle: int = WORDS) -> np.ndarray:
    """Signed XXH64 of a text's distinct shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    return np.unique(np.fromiter({digest(join(p), SEED) for p in parts}, np.uint64).view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    """Sets of n and of any other size that have that similarity share one of their first so many members."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are frequent in a sample of texts, sorted, and their ranks by frequency. They only set
    the order in which prefixes are taken; any order finds the same links."""
    bound_batches(docs.sparkSession)
    data = text_bytes(text_col)
    share = min(1.0, SAMPLE / max(1, docs.count()))
    h = F.xxhash64(data)
    some = docs.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20))).select(h.alias("h"), data.alias("t")).dropDuplicates(["h"]).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text.as_py()))], names=["s"])

    counts = some.mapInArrow(run, "s bigint").groupBy("s").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "s").limit(MAX_COMMON).toPandas().sort_values("s")
    hashes, often = found["s"].to_numpy(np.int64), found["count"].to_numpy(np.int64)
    ranks = np.empty(len(hashes), np.int64)
    ranks[np.lexsort((hashes, often))] = np.arange(1, len(hashes) + 1)
    return hashes, ranks


def _prefixed(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, h, fp, n, prefix) for each row: its text's 128-bit digest, fingerprint, the size of its shingle set and the
    first of the set's hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col))

    def make():
        common, ranks = shared.value

        def one(row):
            fp, own = fingerprint(row[2]), shingle_hashes(row[2])
            n = len(own)
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                own = own[np.argsort(np.where(common[at] == own, ranks[at], 0), kind="stable")]
            prefix = own[: prefix_length(n, similarity)] if n else own
            return row[0], row[1], _signed(fp), n, prefix.tolist()

        return one

    data = text_bytes(text_col)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), text_digest(text_col).alias("h"), data.alias("text"))
    return map_rows(narrow, make, "id bigint, h binary, fp bigint, n int, prefix array<bigint>", weigh=4)


def text_digest(text_col: str) -> Column:
    """128 bits that tell texts apart (null counts as empty)."""
    return F.unhex(F.md5(text_bytes(text_col)))


def _meeting(side: DataFrame, row_bytes: int) -> DataFrame:
    """That side of a join, marked to be broadcast if it is known to be small; else both sides are shuffled."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def shared_postings(nodes: DataFrame) -> DataFrame:
    """(key, node, n): the members of all prefixes that more than one node has. nodes: (node, n, prefix).

    Counts are summed where postings are made, so a hot key costs each task one row; postings of single nodes,
    which are most of them, are never shuffled where the keys that remain are few enough to broadcast."""
    posted = nodes.select("node", "n", F.explode("prefix").alias("key"))
    keys = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("key_"))
    keys = reliable_checkpoint(keys)
    return reliable_checkpoint(posted.join(_meeting(keys, KEY_ROW), F.col("key") == F.col("key_"), "left_semi").select("key", "node", "n"))


def _likely(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those meetings (a, b, na, nb), one for each shared prefix member, that can be similar: what
    they share beyond the prefixes is at most the rest of one set."""
    rest = F.greatest(*[F.ceil(F.lit(similarity) * F.col(n) - 1e-9) - 1 for n in ("na", "nb")])
    need = F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-6
    pairs = met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("c"))
    return reliable_checkpoint(pairs.where(F.col("c") + rest >= need).select("a", "b"))


def _sizes_fit(x: str, y: str, similarity: float) -> Column:
    return F.least(x, y) >= F.greatest(x, y) * similarity - 1e-6


def pivot_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b): candidates of each posting list's least node with its other members."""
    pivots = shared.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"))
    pivots = pivots.select(F.col("key").alias("key_"), F.col("p.node").alias("a"), F.col("p.n").alias("na"))
    met = shared.join(pivots, F.col("key") == F.col("key_")).where((F.col("node") > F.col("a")) & _sizes_fit("n", "na", similarity))
    return _likely(met.select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")), similarity)


def other_pairs(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): candidates among all members of each posting list that roots (node, root) do not join yet."""
    named = roots.select(F.col("node").alias("node_"), "root")
    posted = shared.join(named, F.col("node") == F.col("node_"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    posted = reliable_checkpoint(posted)
    mixed = posted.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    mixed = reliable_checkpoint(mixed.select(F.col("key").alias("key_"), F.ceil(F.col("c") / LIST_PART).cast("int").alias("parts")))
    kept = reliable_checkpoint(posted.join(mixed, F.col("key") == F.col("key_")).select("key", "node", "n", "root", "parts"))
    # One side of a long list is dealt into parts, each of which meets all members.
    x = kept.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    y = kept.select(F.col("key").alias("key_"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_"))
    met = x.join(y, (F.col("key") == F.col("key_")) & (F.col("part") == F.col("part_"))).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sizes_fit("na", "nb", similarity))
    return _likely(met.select("a", "b", "na", "nb"), similarity)


def shingles(text: bytes, shingle: int = WORDS) -> set[bytes]:
    """Distinct shingles of a text; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return {b" ".join(p) for p in zip(*(words[i:] for i in range(shingle)))}


def verified(pairs: DataFrame, names: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' shingle sets have at least that Jaccard similarity. names: (node, h).
    Only texts of candidates are shuffled where their digests are few enough to broadcast."""
    bound_batches(docs.sparkSession)
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select(F.col("b").alias("w"))).distinct()
    wanted = reliable_checkpoint(names.join(wanted, F.col("node") == F.col("w"), "left_semi").select("node", F.col("h").alias("h_")))
    texts = docs.select(text_digest(text_col).alias("h"), text_bytes(text_col).alias("t"))
    texts = texts.join(_meeting(wanted, DIGEST_ROW), F.col("h") == F.col("h_")).groupBy("node").agg(F.first("t").alias("t"))
    side = lambda name, t: texts.select(F.col("node").alias(name + "_"), F.col("t").alias(t))
    # The larger node comes first: it is in few pairs, while the smaller one may be the pivot of many.
    both = pairs.join(side("b", "y"), F.col("b") == F.col("b_")).join(side("a", "x"), F.col("a") == F.col("a_")).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, one = None, set()
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for i, own in enumerate(a.to_pylist()):
                if own != node:
                    node, one = own, shingles(x[i].as_py())
                other = shingles(y[i].as_py())
                shared = len(one & other)
                keep.append(shared > 0 and shared / (len(one) + len(other) - shared) >= similarity)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])
            pa.default_memory_pool().release_unused()

    return reliable_checkpoint(both.mapInArrow(run, "a bigint, b bigint"))


def similar_texts(rows: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(node, h) of all distinct texts, and (node, root) of those that links join. rows: those of _prefixed."""
    nodes = rows.groupBy("h").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # Numbers that are unique by construction stand for texts; which text has which number decides nothing.
    nodes = reliable_checkpoint(nodes.select(F.monotonically_increasing_id().alias("node"), "*"))
    names = reliable_checkpoint(nodes.select("node", "h", "fp"))
    # One text stands for each fingerprint; the other texts with that fingerprint link to it.
    stands = reliable_checkpoint(names.groupBy("fp").agg(F.min("node").alias("stand"), F.count("*").alias("n")))
    same = names.join(stands.where("n > 1").withColumnRenamed("fp", "fp_"), F.col("fp") == F.col("fp_")).where("node <> stand").select(F.col("node").alias("a"), F.col("stand").alias("b"))
    named = lambda side: stands.select(F.col("fp").alias(side + "_"), F.col("stand").alias(side + "s"))
    near = links(stands.select("fp")).join(named("a"), F.col("a") == F.col("a_")).join(named("b"), F.col("b") == F.col("b_")).select(F.col("as").alias("a"), F.col("bs").alias("b"))
    shared = shared_postings(nodes)
    joined = reliable_checkpoint(same.union(near).union(verified(pivot_pairs(shared, similarity), names, docs, text_col, similarity)))
    roots = components(joined)
    # Pairs that the pivots have joined need no look; all others that share a list get one.
    rest = verified(other_pairs(shared, roots, similarity), names, docs, text_col, similarity)
    return names.select("node", "h"), roots if rest.isEmpty() else components(joined.union(rest))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id (null last), then the
    smallest text digest; of rows that agree in both, the first by the JSON form of all their columns. Texts are in a
    group when links join them: fingerprints of at most MAX_BITS differing bits, or 5-word shingle sets of at least
    that Jaccard similarity.

    A text that is alone stays without a look-up: only texts that have copies or go are looked up."""
    rows = reliable_checkpoint(_prefixed(docs, id_col, text_col, similarity))
    names, roots = similar_texts(rows, docs, text_col, similarity)
    order = F.struct(F.col("id").isNull().alias("n"), "id", "h")
    # Counts by id and text find rows that agree in both.
    texts = rows.groupBy("h", "id").agg(F.count("*").alias("c")).groupBy("h").agg(F.min(order).alias("k"), F.sum("c").alias("c"), F.max("c").alias("most"))
    texts = texts.join(names.select("node", F.col("h").alias("h_")), F.col("h") == F.col("h_")).drop("h_").join(roots.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left")
    texts = reliable_checkpoint(texts.select("h", "k", "c", "most", F.coalesce("root", "node").alias("root")))
    best = texts.groupBy("root").agg(F.min("k").alias("best")).withColumnRenamed("root", "root_")
    facts = texts.join(best, F.col("root") == F.col("root_")).select(F.col("h").alias("h_"), (F.col("k") != F.col("best")).alias("goes"), F.col("k.id").alias("stays"), "c", (F.col("most") > 1).alias("again"))
    facts = reliable_checkpoint(facts.where("goes or c > 1").drop("c"))
    # The document travels as one value, so that none of its columns can be taken for one of these.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"), text_digest(text_col).alias("h"))
    kept = own.join(_meeting(facts, DIGEST_ROW), F.col("h") == F.col("h_"), "left").where(F.col("h_").isNull() | (~F.col("goes") & F.col("id").eqNullSafe(F.col("stays"))))
    again = F.coalesce("again", F.lit(False))
    out = kept.where(~again).select("row")
    if not facts.where("again and not goes").isEmpty():
        once = kept.where(again).groupBy("h", "id").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.union(once.select("row"))
    return out.select("row.*")
