"""Byte-level BPE through one table of distinct words, and back through an id-to-piece table.

Texts are read in blocks (Arrow batches) and split into words by the byte-level pre-tokenizer's pattern (after the strings of
added tokens are cut out, which are words and ids of their own); a text with characters outside PLAIN, whose classes libraries
disagree on in places, is split by the tokenizer's own pre-tokenizer. A block becomes its distinct words and, for
every position of its texts, a number into them. Distinct words of all blocks are counted, and those in
more than one block are encoded once, by the tokenizer's own merge model: that is the word table (word, ids, n).

The distinct words of each block are joined with the table and put back by position. Rows of a block
follow each other in one task before and after a broadcast join, so nothing but distinct words is ever shuffled. A word that
only one block has is encoded there, which is once as well. The table holds at most BROADCAST_BYTES: beyond that
the most frequent words are in it, and a rarer word is encoded in each block that has it.

Decoding goes the same way: the distinct ids of each block of texts are joined with the pieces of the vocabulary (one
row for each id, at most some 50,000) and put back by position, and the joined bytes are read as UTF-8.

Edge cases: a null text counts as empty and has no tokens; null ids and repeated rows pass through row by
row; words of any length are encoded whole; null ids (the list) decode to a null text, an id without a piece
decodes to nothing; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import reliable_checkpoint
from .common import bound_batches, schema_names, text_or_empty

#: Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are known to agree (the tests go through all of them): Latin, dashes and quotes.
PLAIN = r"\x00-\u024F\u2010-\u2027\u2030-\u203A\u20AC"
#: The word table is at most so large.
BROADCAST_BYTES = 24 << 20
#: What a row of it takes besides its word and ids.
ROW_BYTES = 64
#: Ids below this are looked up in an array.
DENSE_IDS = 1 << 20
#: Tokens whose bytes are put together at once.
TOKENS_AT_ONCE = 1 << 18
#: What a block carries besides its keys.
OWN = ("docs", "counts", "codes")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordCoder:
    """Splits texts into words and encodes single words, for one tokenizer file."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        stage = spec["pre_tokenizer"] or {}
        flags = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if spec["normalizer"] or stage.get("type") != "ByteLevel" or stage.get("add_prefix_space") or not stage.get("use_regex") or flags:
            raise ValueError("only plain byte-level tokenizers are supported")
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.letters = dict(enumerate(_byte_letters()))
        self.pattern = regex.compile(PATTERN)
        self.strange = re.compile(f"[^{PLAIN}]").search

    def _plain(self, text: str) -> list[str]:
        if self.strange(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def split(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        words: list[str] = []
        for part in self.cut.split(text):
            words += [part] if part in self.added else self._plain(part)
        return words

    def word(self, word: str) -> bytes:
        """Ids as unsigned 32-bit integers, little-endian as all machines are that Spark's Arrow exchange runs on."""
        if word in self.added:
            return array("I", [self.added[word]]).tobytes()
        pieces = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return array("I", [p.id for p in pieces]).tobytes()


def pieces_of(definition: str) -> dict[int, bytes]:
    """The bytes of each id."""
    spec = json.loads(definition)
    back = {c: b for b, c in enumerate(_byte_letters())}
    pieces = {i: bytes(back[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if all(c in back for c in piece)}
    return pieces | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


@lru_cache(2)
def _coder(definition: str) -> WordCoder:
    return WordCoder(definition)


def _definition(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as file:
        return file.read()


def distinct_words(docs: DataFrame, definition: str, text_col: str = "text") -> DataFrame:
    """(word): the distinct words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _coder(definition).split
        for batch in batches:
            words: set[str] = set()
            for text in batch.column(0):
                words.update(split(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])
            pa.default_memory_pool().release_unused()

    bound_batches(docs.sparkSession)
    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word string")


def word_table(words: DataFrame, definition: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """(word, ids, n): words in more than one block, each encoded once, and the number of their blocks; the most frequent ones
    that fit into so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = _coder(definition).word
        for batch in batches:
            ids = pa.array([word(w.as_py()) for w in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, batch.column(1)], names=["word", "ids", "n"])
        pa.default_memory_pool().release_unused()

    counted = reliable_checkpoint(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    # A word has at most one id of four bytes for each of its bytes.
    octave = F.floor(F.log2("n")).cast("int")
    sizes = counted.groupBy(octave.alias("o")).agg(F.sum(F.octet_length("word") * 5 + ROW_BYTES).alias("s")).collect()
    held, least = 0, 64
    for o, size in sorted(((r.o, r.s) for r in sizes), reverse=True):
        if held + size > most:
            break
        held, least = held + size, o
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reliable_checkpoint(counted.where(octave >= least).repartition(spread, "word").mapInArrow(run, "word string, ids binary, n bigint"))


def _text_blocks(docs: DataFrame, definition: str, id_col: str, text_col: str) -> DataFrame:
    """One row for each block: its distinct words, and of its texts the ids, numbers of words and the words' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _coder(definition).split
        for batch in batches:
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__
            counts, codes = array("i"), array("i")
            for text in batch.column(1):
                words = split(text.as_py())
                counts.append(len(words))
                codes.extend(map(number.__getitem__, words))
            yield pa.RecordBatch.from_arrays([_packed(batch.column(0)), pa.array([counts.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([list(number)], pa.list_(pa.string()))], names=["docs", "counts", "codes", "keys"])
            pa.default_memory_pool().release_unused()

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("bigint"), text_or_empty(text_col))
    return narrow.mapInArrow(run, "docs binary, counts binary, codes binary, keys array<string>")


def _id_blocks(coded: DataFrame, id_col: str) -> DataFrame:
    """One row for each block of (id, ids): its distinct token ids, and the texts' ids, numbers of tokens (-1: no list)
    and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [None if x is None else np.asarray(x, np.int32) for x in map(_value, batch.column(1))]
            counts = np.array([-1 if x is None else len(x) for x in lists], np.int32)
            yield _id_block(_packed(batch.column(0)), counts, np.concatenate([np.zeros(0, np.int32), *(x for x in lists if x is not None)]))

    bound_batches(coded.sparkSession)
    return coded.select(F.col(id_col).cast("bigint"), "ids").mapInArrow(run, _ID_BLOCK)


_ID_BLOCK = "docs binary, counts binary, codes binary, keys array<int>"


def _packed(ids: pa.Array) -> pa.Array:
    """Ids and which of them there are as one binary value: rows with lists are measured slowly on their way to Python."""
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + there.tobytes()], pa.binary())


def _unpacked(data: bytes) -> pa.Array:
    n = len(data) // 9
    return pa.array(np.frombuffer(data, np.int64, n), pa.int64(), mask=~np.frombuffer(data, bool, n, 8 * n))


def _id_block(docs: pa.Array, counts: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    keys = _distinct(tokens)
    return pa.RecordBatch.from_arrays([docs, pa.array([counts.tobytes()], pa.binary()), pa.array([tokens.tobytes()], pa.binary()), pa.array([keys], pa.list_(pa.int32()))], names=["docs", "counts", "codes", "keys"])


def _distinct(tokens: np.ndarray) -> np.ndarray:
    if not len(tokens) or tokens.min() < 0 or tokens.max() >= DENSE_IDS:
        return np.unique(tokens)
    seen = np.zeros(int(tokens.max()) + 1, bool)
    seen[tokens] = True
    return np.flatnonzero(seen).astype(np.int32)


def _numbers(tokens: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each token's place among the ascending keys."""
    if not len(tokens) or keys[0] < 0 or keys[-1] >= DENSE_IDS:
        return np.searchsorted(keys, tokens)
    places = np.zeros(int(keys[-1]) + 1, np.int32)
    places[keys] = np.arange(len(keys), dtype=np.int32)
    return places[tokens]


def _value(x: pa.Scalar):
    """The value of a scalar; lists of numbers as arrays."""
    return x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) and x.is_valid else x.as_py()


def spread_out(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of pieces of those sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _joined(blocks: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """(pos, rest, value, docs, counts, codes): one row for each key of a block; value is what the table has for it, rest the
    key where it has none; the block's own columns are on its first row."""
    rows = blocks.select("*", F.posexplode_outer("keys").alias("pos", "k")).join(F.broadcast(table), F.col("k") == F.col(key), "left")
    pos = F.coalesce("pos", F.lit(0))
    first = [F.when(pos == 0, F.col(c)).alias(c) for c in OWN]
    return rows.select(pos.alias("pos"), F.when(F.col(value).isNull(), F.col("k")).alias("rest"), F.col(value).alias("value"), *first)


def assemble(rows: DataFrame, schema: str, finish: Callable[[dict, np.ndarray, bytes], Iterator[pa.RecordBatch]], rest: Callable[[], Callable[[object], bytes]]) -> DataFrame:
    """What finish makes of each block of _joined, whose rows follow each other by pos from 0: its own columns, the sizes of its
    keys' values and the values. rest makes, once in a task, the function that gives the value of a key that has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = rest()
        now, last = None, -2  # the block's own columns, sizes and values so far; the last position

        def done():
            own, sizes, data = now
            return finish(own, np.concatenate(sizes), b"".join(data))

        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column("pos").to_numpy(zero_copy_only=False)
            before = np.concatenate([[last], pos[:-1]])
            if not ((pos == 0) | (pos == before + 1)).all():
                raise RuntimeError("the rows of a block do not follow each other")
            last = int(pos[-1])
            value = batch.column("value")
            if value.null_count:
                keys, filled = batch.column("rest"), value.to_pylist()
                for i in np.flatnonzero(value.is_null().to_numpy(zero_copy_only=False)).tolist():
                    key = keys[i].as_py()
                    filled[i] = b"" if key is None else fill(key)
                value = pa.array(filled, pa.binary())
            offsets = np.frombuffer(value.buffers()[1], np.int32)[value.offset : value.offset + len(value) + 1]
            data = memoryview(value.buffers()[2] or b"")
            starts = np.flatnonzero(pos == 0).tolist()
            for s, e in zip([0, *starts] if not starts or starts[0] else starts, [*(starts if not starts or starts[0] else starts[1:]), len(pos)]):
                if pos[s] == 0:
                    if now is not None:
                        yield from done()
                    now = ({c: batch.column(c)[s].as_py() for c in OWN}, [], [])
                now[1].append(np.diff(offsets[s : e + 1]))
                now[2].append(bytes(data[offsets[s] : offsets[e]]))
            pa.default_memory_pool().release_unused()
        if now is not None:
            yield from done()

    return rows.mapInArrow(run, schema)


def _tokens(own: dict, sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's tokens, and the number of tokens of each of its texts."""
    codes, words = np.frombuffer(own["codes"], np.int32), np.frombuffer(own["counts"], np.int32)
    sizes = sizes // 4
    many = sizes[codes]
    tokens = np.frombuffer(data, np.int32)[spread_out((np.cumsum(sizes) - sizes)[codes], many)]
    ends = np.concatenate([[0], np.cumsum(many)])[np.cumsum(words)] if len(words) else np.zeros(0, np.int64)
    return tokens, np.diff(ends, prepend=0).astype(np.int32)


def _encoded_blocks(docs: DataFrame, definition: str, id_col: str, text_col: str, most: int) -> DataFrame:
    table = word_table(distinct_words(docs, definition, text_col), definition, most)
    return _joined(_text_blocks(docs, definition, id_col, text_col), table.select("word", "ids"), "word", "ids")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """(id, ids array<int>) for each row: token ids in order."""
    definition = _definition(path)

    def finish(own: dict, sizes: np.ndarray, data: bytes) -> Iterator[pa.RecordBatch]:
        tokens, counts = _tokens(own, sizes, data)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(tokens, pa.int32()))
        yield pa.RecordBatch.from_arrays([_unpacked(own["docs"]), lists], names=[id_col, "ids"])

    rows = _encoded_blocks(docs, definition, id_col, text_col, most)
    return assemble(rows, f"{id_col} bigint, ids array<int>", finish, lambda: _coder(definition).word)


def piece_table(spark: SparkSession, definition: str) -> DataFrame:
    """(piece_id, piece): one row for each id of the vocabulary."""
    pieces = pieces_of(definition)
    return spark.createDataFrame(pa.table({"piece_id": pa.array(pieces, pa.int32()), "piece": pa.array(pieces.values(), pa.binary())}))


def _decoded(blocks: DataFrame, definition: str, schema: str, columns: Callable[[pa.Array, np.ndarray, np.ndarray, list], list[pa.Array]]) -> DataFrame:
    """The texts of blocks of ids; columns makes what is returned of document ids, tokens, numbers of tokens and texts."""
    names = schema_names(schema)

    def finish(own: dict, sizes: np.ndarray, data: bytes) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.frombuffer(own["codes"], np.int32), np.frombuffer(own["counts"], np.int32)
        many, at = np.maximum(counts, 0), 0
        codes = _numbers(tokens, _distinct(tokens))
        source, starts = np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes
        ends, docs = np.cumsum(many), _unpacked(own["docs"])
        # Some texts at a time, so that their bytes' places take bounded memory.
        while at < len(many):
            first = int(ends[at] - many[at])
            to = max(at + 1, int(np.searchsorted(ends, first + TOKENS_AT_ONCE, side="right")))
            part = codes[first : int(ends[to - 1])]
            size = sizes[part]
            joined = source[spread_out(starts[part], size)].tobytes()
            borders = np.concatenate([[0], np.cumsum(size)])[ends[at:to] - first].tolist()
            texts = [None if c < 0 else joined[a:b].decode("utf-8", "replace") for c, a, b in zip(counts[at:to].tolist(), [0, *borders], borders)]
            yield pa.RecordBatch.from_arrays(columns(docs[at:to], tokens[first : int(ends[to - 1])], counts[at:to], texts), names=names)
            at = to

    rows = _joined(blocks, piece_table(blocks.sparkSession, definition), "piece_id", "piece")
    return assemble(rows, schema, finish, lambda: lambda _: b"")


def decode_documents(coded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) for each row of (id, ids array<int>): the text of its ids; null ids have a null text."""
    columns = lambda docs, tokens, counts, texts: [docs, pa.array(texts, pa.string())]
    return _decoded(_id_blocks(coded, id_col), _definition(path), f"{id_col} bigint, text string", columns)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) of each document encoded and decoded again; ids_sha256 is that of
    the ids as little-endian unsigned 32-bit integers."""
    definition = _definition(path)

    def to_ids(own: dict, sizes: np.ndarray, data: bytes) -> Iterator[pa.RecordBatch]:
        tokens, counts = _tokens(own, sizes, data)
        yield _id_block(pa.array([own["docs"]], pa.binary()), counts, tokens)

    def columns(docs: pa.Array, tokens: np.ndarray, counts: np.ndarray, texts: list) -> list[pa.Array]:
        borders = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        ids = [digest(tokens[a:b].tobytes()) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
        return [docs, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(borders, pa.array(tokens, pa.int32())), pa.array(ids, pa.string()), pa.array([digest(t.encode()) for t in texts], pa.string())]

    blocks = assemble(_encoded_blocks(docs, definition, id_col, text_col, most), _ID_BLOCK, to_ids, lambda: _coder(definition).word)
    return _decoded(blocks, definition, f"{id_col} bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string", columns)
