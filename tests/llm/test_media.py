from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from corvane.llm import media
from corvane.llm.queries import op1_media


def test_query_against_brute_force(spark, sf_dir, few):
    _, texts = few
    found = op1_media(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        data = texts[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.status) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), "ok")
    same = {}
    for r in found:
        assert same.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_odd_rows(odd, empty, clashing):
    rows = media.read_png(media.encode_png(odd)).collect()
    assert len(rows) == odd.count() and {r.status for r in rows} == {"ok"}
    assert {r.payload_bytes for r in rows if r.n_bytes == 0} == {576}
    assert media.read_png(media.encode_png(empty)).count() == 0
    assert media.encode_png(clashing).count() == odd.count()


def _filtered(samples, kinds):
    """Rows filtered by the definitions, one byte at a time."""
    height, width, step = samples.shape[0], samples.shape[1] * samples.shape[2], samples.shape[2]
    flat = samples.reshape(height, width).astype(int)
    out = b""
    for y in range(height):
        row = bytearray([kinds[y]])
        for x in range(width):
            a = flat[y, x - step] if x >= step else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            paeth = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            row.append((flat[y, x] - [0, a, b, (a + b) // 2, paeth][kinds[y]]) & 255)
        out += row
    return out


@pytest.mark.parametrize(("colour", "channels"), media.CHANNELS.items())
def test_all_filters(colour, channels):
    draw = np.random.default_rng(colour)
    samples = draw.integers(0, 256, (11, 5, channels), dtype=np.uint8)
    raw = _filtered(samples, [0, 1, 1, 2, 2, 3, 4, 4, 3, 1, 2])
    head = struct.pack(">IIBBBBB", 5, 11, 8, colour, 0, 0, 0)
    packed = zlib.compress(raw)
    data = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"note") + media._chunk(b"IDAT", packed[:9]) + media._chunk(b"IDAT", packed[9:]) + media._chunk(b"IEND", b"")
    assert (media.read_png_bytes(data) == samples).all()
    assert len(media.cosine_hash(samples)) == 16


def test_damage_is_reported(spark):
    good = media.write_png(np.arange(576, dtype=np.uint32).astype(np.uint8).reshape(24, 24))
    bad_crc = good[:40] + bytes([good[40] ^ 1]) + good[41:]
    cut = good[:-20]
    squeezed = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 24, 24, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", b"junk") + media._chunk(b"IEND", b"")
    short = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 24, 24, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"ab")) + media._chunk(b"IEND", b"")
    deep = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 24, 24, 16, 0, 0, 0, 0)) + media._chunk(b"IEND", b"")
    cases = [good, bad_crc, cut, b"GIF89a..", squeezed, short, deep, None]
    df = spark.createDataFrame([(i, 576, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "doc_id bigint, n_bytes bigint, media binary")
    assert [r.status for r in media.read_png(df).orderBy("doc_id").collect()] == ["ok", "crc", "truncated", "signature", "deflate", "size", "unsupported", "null"]


def test_hash_sees_low_frequencies_only():
    draw = np.random.default_rng(0)
    smooth = lambda: np.kron(draw.integers(0, 255, (5, 5)), np.ones((16, 16))).astype(np.uint8)[:, :, None]
    base, other = smooth(), smooth()
    noisy = base ^ (np.indices((80, 80)).sum(axis=0) % 2).astype(np.uint8)[:, :, None]
    bits = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert bits(base, noisy) <= 6 and bits(base, other) >= 16
