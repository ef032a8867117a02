"""Headers of images, and hashes of their decoded pixels."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sievemark.functions import png


_SHIFT = 22


@lru_cache(maxsize=32)
def _weights(size: int, out: int) -> np.ndarray:
    """out by size whole numbers of 2 ** -22: a windowed sinc of three lobes, as wide as the image shrinks."""
    scale = size / out
    wide = max(scale, 1.0)
    centre = ((np.arange(out) + 0.5) * scale)[:, None]
    at = np.arange(size)[None, :]
    first, last = np.maximum(0, (centre - 3 * wide + 0.5).astype(np.int64)), (centre + 3 * wide + 0.5).astype(np.int64)
    x = (at - centre + 0.5) / wide
    w = np.where((np.abs(x) < 3) & (at >= first) & (at < last), np.sinc(x) * np.sinc(x / 3), 0.0)
    return np.floor(w / w.sum(axis=1, keepdims=True) * (1 << _SHIFT) + 0.5).astype(np.int64)


def resampled(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image in another size: columns first, then rows, each pass rounded to bytes; a pass that changes nothing is left out."""
    part = lambda sums: np.clip((sums + (1 << (_SHIFT - 1))) >> _SHIFT, 0, 255)
    out = gray.astype(np.int64)
    if out.shape[1] != width:
        out = part(out @ _weights(out.shape[1], width).T)
    if out.shape[0] != height:
        out = part(_weights(out.shape[0], height) @ out)
    return out.astype(np.uint8)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of 299, 587 and 114 thousandths, in 16-bit fractions."""
    return ((rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def perceptual_hash_of(gray: np.ndarray, side: int = 8, factor: int = 4) -> str:
    """16 hex digits: which of the lowest side * side cosine coefficients of the shrunk image are over their median."""
    n = side * factor
    small = resampled(gray, n, n).astype(float)
    wave = np.cos(np.pi * (2 * np.arange(n) + 1)[None, :] * np.arange(side)[:, None] / (2 * n))
    low = wave @ small @ wave.T
    bits = (low > np.median(low)).reshape(-1)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{side * side // 4}x}"


@F.pandas_udf(StringType())
def perceptual_hash(width: pd.Series, height: pd.Series, gray: pd.Series) -> pd.Series:
    """Of one byte per pixel, row by row; null where the bytes don't fit the size."""
    one = lambda w, h, g: perceptual_hash_of(np.frombuffer(g, np.uint8).reshape(h, w)) if g is not None and w > 0 and h > 0 and len(g) == w * h else None
    return pd.Series([one(*x) for x in zip(width, height, gray, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def pixel_hash(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
    """SHA-256 of the size and of three bytes per pixel."""
    one = lambda w, h, x: hashlib.sha256(f"{w}x{h}:RGB".encode() + x).hexdigest() if x is not None else None
    return pd.Series([one(*x) for x in zip(width, height, rgb, strict=True)], dtype=object)


# Kinds of a JPEG's segments that hold the size of its picture, and those without a length.
_JPEG_SIZES = frozenset({*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC})
_JPEG_BARE = frozenset({0x01, *range(0xD0, 0xD9)})


def size_of(content: bytes) -> tuple[str, int, int]:
    """Format, width and height from a PNG's, JPEG's or WebP's headers; ValueError if there are none."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        if len(content) < 24 or content[12:16] != b"IHDR":
            raise ValueError("PNG without a header")
        return "PNG", *struct.unpack_from(">II", content, 16)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        kind = content[12:16]
        if kind == b"VP8X" and len(content) >= 30:
            return "WEBP", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
        if kind == b"VP8L" and len(content) >= 25:
            bits = int.from_bytes(content[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 " and len(content) >= 30:
            width, height = struct.unpack_from("<HH", content, 26)
            return "WEBP", width & 0x3FFF, height & 0x3FFF
        raise ValueError("WebP without a header")
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            kind = content[at + 1]
            if kind == 0xFF or kind in _JPEG_BARE:
                at += 1 if kind == 0xFF else 2
                continue
            if kind in _JPEG_SIZES and at + 9 <= len(content):
                height, width = struct.unpack_from(">HH", content, at + 5)
                return "JPEG", width, height
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
        raise ValueError("JPEG without a size")
    raise ValueError("cannot identify image")


_HEADER = StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("error", StringType())])


@F.pandas_udf(_HEADER)
def image_header(contents: pd.Series) -> pd.DataFrame:
    """What size_of gives, or why it gives nothing; nulls for null."""

    def one(content: bytes | None) -> tuple:
        if content is None:
            return None, None, None, None
        try:
            return *size_of(content), None
        except ValueError as e:
            return None, None, None, str(e)

    rows = pd.DataFrame([one(x) for x in contents], columns=["format", "width", "height", "error"])
    return rows.astype({"width": "Int32", "height": "Int32"})


_PROBE = StructType([*_HEADER.fields[:3], StructField("mode", StringType()), StructField("sha256_pixels", StringType()), StructField("phash64", StringType()), StructField("error", StringType())])
#: Formats whose pixels are decoded; of others the headers are read.
DECODED = ("PNG",)


def probed(content: bytes) -> tuple:
    """Format, width and height (upright), mode, sha256_pixels and phash64; ValueError for what can't be decoded whole."""
    kind, width, height = size_of(content)
    if kind not in DECODED:
        return kind, width, height, None, None, None
    mode, rgb = png.decode(content)
    height, width = rgb.shape[:2]
    digest = hashlib.sha256(f"{width}x{height}:RGB".encode() + rgb.tobytes()).hexdigest()
    return kind, width, height, mode, digest, perceptual_hash_of(grey(rgb))


@F.pandas_udf(_PROBE)
def image_probe(contents: pd.Series) -> pd.DataFrame:
    """What probed gives, or why it gives nothing; nulls for null. Images are decoded one at a time."""

    def one(content: bytes | None) -> tuple:
        if content is None:
            return (None,) * 7
        try:
            return *probed(content), None
        except ValueError as e:
            return *(None,) * 6, str(e)

    rows = pd.DataFrame([one(x) for x in contents], columns=_PROBE.names)
    return rows.astype({"width": "Int32", "height": "Int32"})
