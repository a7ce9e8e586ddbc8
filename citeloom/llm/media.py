"""Texts as images in binary columns: PNG files written and read chunk by chunk, and hashes of their low frequencies.

The payload is a text's UTF-8 bytes, filled with spaces to a positive multiple of 192. It becomes the samples of an RGB
image of 64 pixels (192 bytes) a row. Reading tests the signature, each chunk's CRC-32 and zlib's Adler-32, undoes the
row filters with numpy, and takes the signs of the lowest 8 x 8 cosine coefficients of a 32 x 32 grey image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW, PIXEL = 192, 3
IDAT_BYTES = 1 << 16


def payload_of(data: bytes) -> bytes:
    return data + b" " * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """Each row takes the filter (none, left or above) whose signed bytes have the least sum of magnitudes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    left, above = rows.copy(), rows.copy()
    left[:, PIXEL:] -= rows[:, :-PIXEL]
    above[1:] -= rows[:-1]
    tried = np.stack([rows, left, above])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.concatenate([best.astype(np.uint8)[:, None], tried[best, np.arange(len(rows))]], axis=1)
    body = zlib.compress(lines.tobytes(), 6)
    head = struct.pack(">IIBBBBB", ROW // PIXEL, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an 8-bit RGB image; ValueError where a test fails."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head, ended = 8, [], None, False
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) != n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not a whole 8-bit RGB image")
    width, height = head[0] * PIXEL, head[1]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return _unfiltered(lines[:, 0], lines[:, 1:].copy()).tobytes()


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    for y in np.flatnonzero(kinds):
        row, above = rows[y], rows[y - 1] if y else np.zeros_like(rows[0])
        if kinds[y] == 1:
            rows[y] = row.reshape(-1, PIXEL).cumsum(axis=0, dtype=np.uint8).reshape(-1)
        elif kinds[y] == 2:
            rows[y] = row + above
        elif kinds[y] in (3, 4):
            a, c = np.zeros(PIXEL, np.int16), np.zeros(PIXEL, np.int16)
            for x in range(0, len(row), PIXEL):
                b = above[x : x + PIXEL].astype(np.int16)
                if kinds[y] == 3:
                    guess = (a + b) >> 1
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                a = (row[x : x + PIXEL].astype(np.int16) + guess) & 255
                rows[y, x : x + PIXEL] = a
                c = b
        else:
            raise ValueError("unknown row filter")
    return rows


#: Heights of images up to which the transforms are remembered: 64 bytes a row, so at most 16 MiB in all.
REMEMBERED_ROWS = 512


def _to_low(n: int) -> np.ndarray:
    """8 x n: n samples averaged into 32 cells, then their 8 lowest cosine coefficients."""
    return _remembered(n) if n <= REMEMBERED_ROWS else _transform(n)


@lru_cache(maxsize=REMEMBERED_ROWS)
def _remembered(n: int) -> np.ndarray:
    return _transform(n)


def _transform(n: int) -> np.ndarray:
    edges = np.arange(33) * n / 32
    cells = np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, None) * (32 / n)
    return np.cos(np.pi / 32 * np.outer(np.arange(8), np.arange(32) + 0.5)) @ cells


def low_frequency_hash(samples: bytes) -> bytes:
    """8 bytes: bit i tells whether coefficient i lies above the median of the 63 without the mean."""
    grey = np.frombuffer(samples, np.uint8).reshape(-1, ROW // PIXEL, PIXEL).mean(axis=2)
    low = np.round(_to_low(len(grey)) @ grey @ _to_low(ROW // PIXEL).T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [x.encode("utf-8") for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array((encode_png(payload_of(x)) for x in data), pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"payload": [], "feature": []}
        for media in b.column("media").to_pylist():
            samples = decode_png(media)
            out["payload"].append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest()))
            out["feature"].append(low_frequency_hash(samples))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([x[i] for x in out["payload"]], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns, pa.array(out["feature"], pa.binary())], FEATURES)


FEATURES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"]


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the PNG file as binary, for each row of docs. A null text counts as empty (one row of spaces); a null doc_id stays null; other columns are ignored."""
    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored files hold: payload size and digests, and hash, 8 bytes of low-frequency signs. Broken files fail the job."""
    small_batches(media.sparkSession)
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")
