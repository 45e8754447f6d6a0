"""Media columns: PNG images in a binary column, read back with checks and hashed by low frequencies.

encode_png stores each text's bytes as an 8-bit grey image of width 24: the payload is the UTF-8 text
with bytes 255 appended up to a positive multiple of 576, so that an image is a column of 24 x 24 tiles.
read_png parses any non-interlaced 8-bit grey, grey+alpha, RGB or RGBA image of that column: it tests the
signature and every chunk's CRC-32, inflates the data chunks, undoes the row filters in numpy, and hashes
the two-dimensional cosine transform of the image (reduced to 32 x 32): one bit for each of the 63 lowest
frequencies but the mean, set where it is over their median.

Edge cases: a null text counts as empty (one tile of 255s); equal texts give equal images and features;
null ids, repeated rows and empty tables pass through row by row; a damaged or null image gets a status
other than 'ok' and null values instead of an error; other columns are left out. One image is in memory
at a time, next to an output batch of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

TILE = 24
BLOCK = TILE * TILE
LEVEL = 6
IDAT_BYTES = 1 << 16
HASH_SIDE, HASH_LOW = 32, 8


class BadImage(ValueError):
    """The stored bytes are no image that this module reads; the message names the reason."""


def pad(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % BLOCK if data else BLOCK)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """An 8-bit grey image. Each row takes the filter, of none, left and up, with the least sum of
    absolute differences."""
    height, width = samples.shape
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    options = np.stack([samples, left, up])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = options[best, np.arange(height)]
    data = zlib.compress(rows.tobytes(), level)
    parts = [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise BadImage("signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("truncated")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body, end = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], at + 12 + n
        if end > len(data):
            raise BadImage("truncated")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise BadImage("crc")
        yield kind, body
        at = end


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the five row filters. rows: filter bytes in column 0; step: bytes of a pixel.

    Runs of rows with one of the filters none, left or up are undone at once by running sums; average and
    Paeth rows, which need each pixel's left neighbour first, go pixel by pixel."""
    kinds, raw = rows[:, 0], rows[:, 1:]
    height, width = raw.shape
    if height and kinds.max() > 4:
        raise BadImage("filter")
    out = np.empty_like(raw)
    above = np.zeros(width, np.uint8)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if height else []
    for a, b in zip(starts, np.r_[starts[1:], height] if height else []):
        kind, block = kinds[a], raw[a:b]
        if kind == 0:
            out[a:b] = block
        elif kind == 1:
            pixels = block.reshape(b - a, width // step, step)
            out[a:b] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kind == 2:
            out[a:b] = np.cumsum(block, axis=0, dtype=np.uint8) + above
        else:
            for r in range(a, b):
                prior = out[r - 1] if r else np.zeros(width, np.uint8)
                out[r] = _sequential(block[r - a].tolist(), prior.tolist(), step, int(kind))
        above = out[b - 1]
    return out


def _sequential(row: list[int], prior: list[int], step: int, kind: int) -> list[int]:
    for i in range(len(row)):
        a = row[i - step] if i >= step else 0
        b = prior[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = prior[i - step] if i >= step else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        row[i] = (row[i] + guess) & 255
    return row


def read_png_bytes(data: bytes) -> np.ndarray:
    """Samples as (height, width, channels); raises BadImage."""
    shape, packed, ended = None, [], False
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            if len(body) != 13:
                raise BadImage("header")
            width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in CHANNELS or method or filters or interlace or not width or not height:
                raise BadImage("unsupported")
            shape = (height, width, CHANNELS[colour])
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise BadImage("unsupported")
    if shape is None or not ended:
        raise BadImage("truncated")
    height, width, channels = shape
    expected = height * (width * channels + 1)
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(packed), expected + 1)
    except zlib.error as error:
        raise BadImage("deflate") from error
    if len(raw) != expected:
        raise BadImage("size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1), channels).reshape(shape)


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(HASH_LOW)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)


_BASIS = _cosines(HASH_SIDE)


def _shrink(grey: np.ndarray, axis: int) -> np.ndarray:
    """Mean over HASH_SIDE even parts of an axis; a shorter axis repeats its samples."""
    n = grey.shape[axis]
    edges = np.arange(HASH_SIDE + 1) * n // HASH_SIDE
    low = np.minimum(edges[:-1], n - 1)
    width = np.maximum(edges[1:] - low, 1)
    sums = np.concatenate([np.zeros_like(grey.take([0], axis)), np.cumsum(grey, axis=axis)], axis=axis)
    shape = [1, 1]
    shape[axis] = -1
    return (sums.take(low + width, axis) - sums.take(low, axis)) / width.reshape(shape)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits; the bit of the mean is always 0."""
    height, width, channels = samples.shape
    # Integer sums are exact, so that the hash does not depend on their order.
    grey = samples[:, :, : 3 if channels > 2 else 1].sum(axis=2, dtype=np.int64)
    small = _shrink(_shrink(grey, 1), 0)
    low = (_BASIS @ small @ _BASIS.T).ravel().round(6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def encode_png(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's byte count and its image."""

    def make():
        def one(row):
            return row[0], len(row[1]), write_png(np.frombuffer(pad(row[1]), np.uint8).reshape(-1, TILE))

        return one

    narrow = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_bytes(text_col).alias("text"))
    return map_rows(narrow, make, f"{id_col} bigint, n_bytes bigint, media binary", weigh=2)


def read_png(images: DataFrame, id_col: str = "doc_id", media_col: str = "media", length_col: str = "n_bytes") -> DataFrame:
    """(id, n_bytes, status, width, height, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature) of each stored image."""

    def make():
        def one(row):
            key, length, media = row
            if media is None:
                return (key, length, "null", *[None] * 8)
            facts = (len(media), hashlib.sha256(media).hexdigest())
            try:
                samples = read_png_bytes(media)
            except BadImage as why:
                return (key, length, str(why), *[None] * 5, *facts, None)
            payload = samples.tobytes()
            return (key, length, "ok", samples.shape[1], samples.shape[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *facts, cosine_hash(samples))

        return one

    schema = f"{id_col} bigint, n_bytes bigint, status string, width int, height int, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_rows(images.select(F.col(id_col).cast("bigint").alias(id_col), F.col(length_col).cast("bigint").alias("n_bytes"), F.col(media_col).alias("media")), make, schema)
