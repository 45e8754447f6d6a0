from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import bpe
from corvane.llm.queries import op6_bpe


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_path())


DEFINITION = bpe._definition(None)
CODER, PIECES = bpe.WordCoder(DEFINITION), bpe.pieces_of(DEFINITION)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "'ll", "  ", "\r\n", "don't", " ٣½²", "\u3000", "\x85", "🙂", "Ⅷ"])), max_size=8))
def test_ids_equal_the_library(tokenizer, parts):
    text = "".join(parts)
    ids = np.frombuffer(b"".join(map(CODER.word, CODER.split(text))), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert b"".join(PIECES[i] for i in ids).decode() == text


def test_every_plain_character(tokenizer):
    plain = [c for c in map(chr, range(0x2100)) if not CODER.strange(c)]
    assert len(plain) > 600
    for c in plain:
        text = f"a{c}b {c} 1{c}'ll{c}\n{c}'s{c}{c} "
        assert CODER.pattern.findall(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_query_against_the_library(spark, sf_dir, few, tokenizer):
    _, texts = few
    for r in op6_bpe(spark, sf_dir).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few texts, so that there are many of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("most", [0, 20_000, 1 << 30])
def test_any_part_of_the_words_may_be_in_the_table(few, odd, tokenizer, small_blocks, most):
    """No word, the frequent ones or all that several blocks have: the ids stay the same."""
    docs = few[0].where("doc_id % 20 = 0").select("doc_id", "text").union(odd.select("doc_id", "text"))
    found = [(r.doc_id, tuple(r.ids)) for r in bpe.encode_documents(docs, most=most).collect()]
    expected = [(r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert Counter(found) == Counter(expected)
    assert sorted(r.ids_sha256 for r in bpe.digests(docs, most=most).collect()) == sorted(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for _, ids in expected)


def test_table_of_distinct_words(few, small_blocks):
    words = bpe.distinct_words(few[0], DEFINITION)
    blocks = Counter(r.word for r in words.collect())
    assert blocks.keys() == {w for t in few[1].values() for w in CODER.split(t)}
    table = bpe.word_table(words, DEFINITION).collect()
    assert {r.word: r.n for r in table} == {w: n for w, n in blocks.items() if n > 1} and len(table) == len({r.word for r in table})
    assert all(bytes(r.ids) == CODER.word(r.word) for r in table)
    some = bpe.word_table(words, DEFINITION, 20_000).collect()
    assert 0 < len(some) < len(table) and min(r.n for r in some) >= max(r.n for r in table if r not in some) / 2


def test_rows_out_of_order_are_refused(spark):
    rows = spark.createDataFrame([(0, None, b"a", b"", b"", b""), (2, None, b"b", None, None, None)], "pos int, rest string, value binary, docs binary, counts binary, codes binary").coalesce(1)
    with pytest.raises(Exception, match="do not follow"):
        bpe.assemble(rows, "n int", lambda own, sizes, data: iter(()), lambda: lambda key: b"").collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.integers(0, 40))
def test_pieces_are_spread_out(sizes, shift):
    sizes = np.array(sizes, np.int64)
    starts = (np.cumsum(sizes) - sizes)[::-1] + shift
    assert bpe.spread_out(starts, sizes[::-1]).tolist() == [a + i for a, n in zip(starts.tolist(), sizes[::-1].tolist()) for i in range(n)]


def test_odd_rows(odd, empty, clashing):
    rows = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect())
    assert bpe.digests(empty).count() == 0
    assert bpe.digests(clashing).count() == odd.count()
    assert {r.n_tokens for r in bpe.digests(odd.where("text is null or text = ''")).collect()} == {0}


def test_unknown_ids_and_nulls(spark):
    df = spark.createDataFrame([(1, [9_999_999, 32]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(df).collect()} == {1: PIECES[32].decode(), 2: None, 3: ""}


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.WordCoder(bpe._definition(public_tokenizers.path("word_bpe_49k.json")))
