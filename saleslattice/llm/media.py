"""Media columns: Netpbm and BMP images as numpy arrays, integral-image thumbnails, NPY tiles, difference hashes.

``media_columns(df)`` packs each row's bytes losslessly into an image, stores it, reads it back and describes it.
Null and empty values are one image of blanks; repeated rows give equal values; other columns are not touched or read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, PAD = 64, 192
_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_format string, tile binary"


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 as height x width x channels of 8 bits; samples of another depth are scaled to 255."""
    kind, at, head = raw[:2], 2, []
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(raw, at)
        if not m:
            raise ValueError("netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, most = (*head, 1)[:3]
    if kind not in (b"P1", b"P4") and not 0 < most < 65536:
        raise ValueError("netpbm depth")
    c = 3 if kind in (b"P3", b"P6") else 1

    def scaled(x: np.ndarray) -> np.ndarray:
        x = x.reshape(h, w, c)
        return x if most == 255 and x.dtype == np.uint8 else ((x.astype(np.int64) * 255 + most // 2) // most).astype(np.uint8)

    if kind in (b"P5", b"P6"):
        return scaled(np.frombuffer(raw, np.uint8 if most < 256 else ">u2", w * h * c, at + 1))
    if kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :w]).astype(np.uint8)[:, :, None] * 255
    body = re.sub(rb"#[^\n]*", b"", raw[at:])
    if kind == b"P1":
        bits = np.array([x - 48 for x in re.sub(rb"\s", b"", body)[: w * h]], np.uint8)
        return ((1 - bits) * 255).reshape(h, w, 1)
    return scaled(np.array(body.split()[: w * h * c], dtype=np.int64))


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as height x width x 3, in RGB."""
    at, head, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", raw, 10)
    if raw[:2] != b"BM" or packed or bits not in (8, 24, 32):
        raise ValueError("BMP kind")
    step = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, step * abs(h), at).reshape(abs(h), step)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        n = struct.unpack_from("<I", raw, 46)[0] or 256
        table = np.frombuffer(raw, np.uint8, 4 * n, 14 + head).reshape(n, 4)
        return table[rows[:, :w]][:, :, 2::-1]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def encode_ppm(img: np.ndarray) -> bytes:
    h, w, c = img.shape
    return b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + np.ascontiguousarray(img).tobytes()


def encode_bmp(img: np.ndarray) -> bytes:
    h, w, _ = img.shape
    body = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    body[:, : 3 * w] = img[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI IiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def integral(gray: np.ndarray) -> np.ndarray:
    out = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    out[1:, 1:] = gray.cumsum(0, dtype=np.int64).cumsum(1)
    return out


def area(total: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean grey of each of rows x cols equal areas, cut through pixels where need be, from an integral image."""
    def lines(n: int, parts: int, table: np.ndarray) -> np.ndarray:
        at = np.linspace(0, n, parts + 1)
        low = np.minimum(at.astype(np.int64), n - 1)
        return table[low] + (at - low)[:, None] * (table[low + 1] - table[low])

    h, w = total.shape[0] - 1, total.shape[1] - 1
    at = lines(w, cols, lines(h, rows, total).T).T
    return np.diff(np.diff(at, axis=0), axis=1) * (rows * cols / (h * w))


def grey(img: np.ndarray) -> np.ndarray:
    if img.shape[2] == 1:
        return img[:, :, 0].astype(np.int64)
    return (img[:, :, :3].astype(np.int64) @ np.array([77, 150, 29])) >> 8


def dhash(total: np.ndarray) -> str:
    a = np.round(area(total, 8, 9), 6)
    return np.packbits(a[:, 1:] > a[:, :-1]).tobytes().hex()


def tile(total: np.ndarray, side: int = 16) -> bytes:
    np.save(out := io.BytesIO(), np.round(area(total, side, side)).astype(np.uint8))
    return out.getvalue()


def payload_of(raw: bytes) -> bytes:
    return raw + b" " * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def store(payload: bytes) -> bytes:
    """Rows of 64 RGB pixels; an even number of rows as PPM, an odd one as BMP."""
    img = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return encode_bmp(img) if img.shape[0] % 2 else encode_ppm(img)


def media_columns(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """One row for each of df's: see the module. ``tile`` is the NPY file of a 16 x 16 grey tile."""

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = t or b""
                media = store(payload_of(raw))
                img = decode(media)
                back = img.tobytes()
                total = integral(grey(img))
                rows.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), dhash(total), "bmp" if media[:2] == b"BM" else "ppm", tile(total)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{col}`").cast("binary").alias("raw")).mapInArrow(run, _SCHEMA)


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_columns(docs).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")
