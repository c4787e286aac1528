"""Media columns: texts stored as PNG images in binary columns, read back, checked and fingerprinted.

A payload is the text's UTF-8 bytes padded with blanks to whole rows of 64 RGB pixels (192 bytes). The
encoder picks a filter for each row, deflates the rows into IDAT chunks and seals every chunk with its
checksum. The decoder tests every checksum, inflates, and undoes the five row filters with numpy. The
fingerprint is the sign pattern of the 63 lowest cosine frequencies of the image shrunk to 32 x 32 grey.

Defined results: a null or empty text is one row of blanks; texts of any length are stored whole, one image
each (PNG allows 2 ** 31 - 1 rows); equal texts give equal images and prints;
repeated rows and null ids are kept as they are; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ready, tidy

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20


class MediaError(ValueError):
    """The stored bytes aren't a PNG that this module can read, or a checksum differs."""


def pad_payload(raw: bytes) -> bytes:
    """Blanks up to a positive multiple of a row."""
    rows = max(1, -(-len(raw) // ROW))
    return raw.ljust(rows * ROW, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit RGB image of width 64; each row takes the filter of None, Sub and Up with the least absolute sum."""
    raw = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub = raw.copy()
    sub[:, CHANNELS:] -= raw[:, :-CHANNELS]
    up = raw.copy()
    up[1:] -= raw[:-1]
    options = np.stack([raw, sub, up])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((len(raw), ROW + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = options[best, np.arange(len(raw))]
    body = zlib.compress(rows.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(raw), 8, 2, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(rows: np.ndarray) -> np.ndarray:
    kinds, data = rows[:, 0], rows[:, 1:]
    out = data.copy()
    sub = kinds == 1
    if sub.any():
        pixels = data[sub].reshape(-1, data.shape[1] // CHANNELS, CHANNELS)
        out[sub] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(-1, data.shape[1])
    if kinds.max(initial=0) <= 1:
        return out
    above = np.zeros(data.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = out[y]
        if kind == 2:
            row += above
        elif kind in (3, 4):
            up, left = above.astype(np.int16), np.zeros(CHANNELS, np.int16)
            corner = left
            for x in range(0, len(row), CHANNELS):
                b = up[x : x + CHANNELS]
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    p = left + b - corner
                    da, db, dc = np.abs(p - left), np.abs(p - b), np.abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, b, corner))
                left = (data[y, x : x + CHANNELS] + guess) & 255
                corner = b
                row[x : x + CHANNELS] = left
        elif kind > 4:
            raise MediaError(f"row filter {kind}")
        above = row
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The image as rows x 192 bytes; every chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, body, head, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(media):
            raise MediaError("a chunk is cut off")
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[0] != WIDTH or head[2:] != (8, 2, 0, 0, 0):
        raise MediaError("not a whole 8-bit RGB image of width 64")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(rows) != head[1] * (ROW + 1):
        raise MediaError("wrong number of samples")
    return _unfilter(rows.reshape(-1, ROW + 1))


def _cosines(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_COS = _cosines(32, 8)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 grey image exceed their median (the mean grey counts as 0)."""
    grey = image.reshape(-1, WIDTH, CHANNELS).mean(axis=2)
    sums = np.zeros((len(grey) + 1, 32))
    np.cumsum(grey.reshape(len(grey), 32, 2).mean(axis=2), axis=0, out=sums[1:])
    cuts = np.linspace(0, len(grey), 33)
    low = np.minimum(cuts.astype(np.int64), len(grey) - 1)
    edge = sums[low] + (sums[low + 1] - sums[low]) * (cuts - low)[:, None]
    small = np.diff(edge, axis=0) * (32 / len(grey))
    freq = (_COS @ small @ _COS.T).round(6).ravel()
    freq[0] = 0
    return np.packbits(freq > np.median(freq)).tobytes()


def store_media(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_bytes, media): the text as a PNG in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                raw = [t or b"" for t in batch.column(1).to_pylist()]
                media = [encode_png(pad_payload(t)) for t in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    ready(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(tidy(run), f"id {kind}, n_bytes long, media binary")
    return rows.withColumnRenamed("id", id_col)


def read_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_bytes, media, payload, print): stored bytes read back whole, checksums tested, and fingerprinted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                images = [decode_png(m) for m in batch.column(2).to_pylist()]
                extra = [pa.array([i.tobytes() for i in images], pa.binary()), pa.array([cosine_hash(i) for i in images], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "payload", "print"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return rows.mapInArrow(tidy(run), f"id {kind}, n_bytes long, media binary, payload binary, print binary").withColumnRenamed("id", id_col)


def media_digest(docs: DataFrame) -> DataFrame:
    """Every document through the image column and back, as lengths, checksums and the print in hex."""
    back = read_media(store_media(docs))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 15, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("print")).alias("feature"),
    )
