"""PNG files to pixels and back, with numpy: chunks, inflation, row filters, interlace, colour types and the stored turn."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: An image of more pixels isn't decoded.
MOST_PIXELS = 178_956_970
# Samples by colour type; the depths that it may have; the seven passes (first column and row, steps).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
_MODES = {(1, 0): "1", (16, 0): "I;16", (8, 4): "LA", (16, 4): "RGBA"}
_MODE_OF_TYPE = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
_TURN_TAG = 0x0112


class Image(NamedTuple):
    """rgb: height by width by 3 bytes, turned upright; mode: that of the file's samples."""

    mode: str
    rgb: np.ndarray


def chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk up to the last; ValueError where one is cut short or damaged."""
    at = len(SIGNATURE)
    while True:
        if at + 12 > len(content):
            raise ValueError("truncated PNG")
        size = int.from_bytes(content[at : at + 4], "big")
        kind, data = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        if at + 12 + size > len(content):
            raise ValueError("truncated PNG")
        if zlib.crc32(data, zlib.crc32(kind)) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"damaged PNG chunk {kind.decode('latin-1')}")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size


def _predicted(band: np.ndarray, above: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Rows of any filters (band: rows, pixels, bytes) below the row above. A byte may need those to the left, above and
    between, so all bytes of a diagonal are reckoned at once: diagonals are rows of `skew`, shifted by their row."""
    rows, width, step = band.shape
    skew = np.zeros((rows + width + 2, rows + 1, step), np.int16)  # skew[x + y + 2, y]: pixel x of row y, row 0 above
    skew[2 : width + 2, 0] = above
    raw = np.zeros((rows + width + 2, rows, step), np.int16)
    y = np.arange(rows)
    raw[np.arange(width)[None, :] + y[:, None] + 3, y[:, None]] = band
    sub, up_by, mean, paeth = ((kinds == k).astype(np.int16)[:, None] for k in (1, 2, 3, 4))
    for t in range(3, rows + width + 2):
        low, high = max(1, t - 1 - width), min(rows, t - 2)
        own = slice(low - 1, high)
        left, up, between = skew[t - 1, low : high + 1], skew[t - 1, own], skew[t - 2, own]
        over, beside = up - between, left - between
        a, b, c = np.abs(over), np.abs(beside), np.abs(over + beside)
        best = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, between))
        guess = sub[own] * left + up_by[own] * up + mean[own] * ((left + up) >> 1) + paeth[own] * best
        skew[t, low : high + 1] = (raw[t, own] + guess) & 255
    return skew[np.arange(width)[None, :] + y[:, None] + 3, y[:, None] + 1].astype(np.uint8)


def unfiltered(data: np.ndarray, rows: int, size: int, step: int) -> np.ndarray:
    """rows by size bytes of rows that each begin with their filter; step: bytes from a pixel to the next. From the first row
    of a filter that looks two ways to the last one, diagonals are reckoned; other rows are sums."""
    lines = data.reshape(rows, size + 1)
    kinds, raw = lines[:, 0], lines[:, 1:]
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown PNG filter")
    hard = np.flatnonzero(kinds >= 3)
    start, end = (int(hard[0]), int(hard[-1]) + 1) if len(hard) else (rows, rows)
    out, above, i = np.empty((rows, size), np.uint8), np.zeros(size, np.uint8), 0
    while i < rows:
        if i == start:
            band = raw[start:end].reshape(end - start, -1, step).astype(np.int16)
            out[start:end] = _predicted(band, above.reshape(-1, step), kinds[start:end]).reshape(end - start, size)
            i = end
        else:
            line = raw[i] if kinds[i] != 2 else raw[i] + above
            out[i] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1) if kinds[i] == 1 else line
            i += 1
        above = out[i - 1]
    return out


def _samples(rows: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """rows by width by samples; of 16 bits the upper eight, of fewer than eight as they are."""
    if depth == 16:
        return rows[:, ::2].reshape(len(rows), width, samples)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :width]
    return rows.reshape(len(rows), width, samples)


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """The pixels as a stored turn (1 to 8) asks for them to be shown."""
    if turn in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def turn_of(exif: bytes) -> int:
    """The turn in an Exif block; 1 where there is none."""
    exif = exif.removeprefix(b"Exif\0\0")
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    try:
        (at,) = struct.unpack_from(f"{order}I", exif, 4)
        (count,) = struct.unpack_from(f"{order}H", exif, at)
        for i in range(count):
            tag, kind, _, value = struct.unpack_from(f"{order}HHIH", exif, at + 2 + 12 * i)
            if tag == _TURN_TAG and kind == 3:
                return value
    except struct.error:
        pass
    return 1


def _inflated(parts: list[bytes], size: int) -> np.ndarray:
    """So many bytes of the joined parts; no more are ever made."""
    try:
        data = zlib.decompressobj().decompress(b"".join(parts), size)
    except zlib.error as e:
        raise ValueError(f"damaged PNG data: {e}") from None
    if len(data) < size:
        raise ValueError("truncated PNG data")
    return np.frombuffer(data, np.uint8)


def decode(content: bytes) -> Image:
    """ValueError for what isn't a whole PNG file. Transparency is ignored; 16-bit samples keep their upper byte."""
    if content[:8] != SIGNATURE:
        raise ValueError("no PNG")
    header, palette, turn, parts = None, None, 1, []
    for kind, data in chunks(content):
        if kind == b"IHDR" and len(data) == 13:
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"eXIf":
            turn = turn_of(data)
        elif kind == b"IDAT":
            parts.append(data)
    if header is None:
        raise ValueError("PNG without a header")
    width, height, depth, colour, packing, filtering, interlace = header
    if depth not in _DEPTHS.get(colour, ()) or packing or filtering or interlace > 1 or not width or not height:
        raise ValueError("PNG of an unknown kind")
    if width * height > MOST_PIXELS:
        raise ValueError("PNG of too many pixels")
    samples = _SAMPLES[colour]
    step = max(1, samples * depth // 8)
    passes = _PASSES if interlace else ((0, 0, 1, 1),)
    shapes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    sizes = [(w * samples * depth + 7) // 8 for w, _ in shapes]
    data, at = _inflated(parts, sum((s + 1) * h for s, (w, h) in zip(sizes, shapes, strict=True) if w > 0 and h > 0)), 0
    pixels = np.zeros((height, width, samples), np.uint8)
    for (x, y, dx, dy), (w, h), size in zip(passes, shapes, sizes, strict=True):
        if w > 0 and h > 0:
            rows = unfiltered(data[at : at + (size + 1) * h], h, size, step)
            pixels[y::dy, x::dx] = _samples(rows, w, depth, samples)
            at += (size + 1) * h
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("PNG without its colours")
        rgb = palette[pixels[:, :, 0]]
    else:
        if depth < 8:
            pixels = pixels * np.uint8(255 // ((1 << depth) - 1))
        rgb = pixels[:, :, :3] if samples > 2 else np.repeat(pixels[:, :, :1], 3, axis=2)
    return Image(_MODES.get((depth, colour), _MODE_OF_TYPE[colour]), np.ascontiguousarray(upright(rgb, turn)))


def _filtered(rows: np.ndarray, step: int, kinds: np.ndarray) -> bytes:
    """Rows of bytes, each behind its filter's number."""
    whole = rows.astype(np.int16)
    left = np.pad(whole, ((0, 0), (step, 0)))[:, : whole.shape[1]]
    up, between = np.pad(whole, ((1, 0), (0, 0)))[:-1], np.pad(left, ((1, 0), (0, 0)))[:-1]
    a, b, c = np.abs(up - between), np.abs(left - between), np.abs(left + up - 2 * between)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, between))
    guess = np.choose(kinds[:, None], [np.zeros_like(whole), left, up, (left + up) >> 1, paeth])
    return np.hstack([kinds[:, None].astype(np.uint8), ((whole - guess) & 255).astype(np.uint8)]).tobytes()


def encode(pixels: np.ndarray, first_filter: int = 0, interlace: bool = False, turn: int = 1, depth: int = 8, palette: np.ndarray | None = None) -> bytes:
    """A PNG of height by width by 1 (grey, or a palette's numbers), 2, 3 or 4 samples of that many bits; rows take the five
    filters in turn, from the first one on."""
    height, width, samples = pixels.shape
    colour = 3 if palette is not None else {1: 0, 2: 4, 3: 2, 4: 6}[samples]
    data = b""
    for x, y, dx, dy in _PASSES if interlace else ((0, 0, 1, 1),):
        part = pixels[y::dy, x::dx]
        if part.size:
            flat = part.reshape(len(part), -1)
            if depth == 16:
                rows = flat.astype(">u2").view(np.uint8).reshape(len(part), -1)
            elif depth < 8:
                bits = (flat[:, :, None] >> np.arange(depth)[::-1]) & 1
                rows = np.packbits(bits.reshape(len(part), -1).astype(np.uint8), axis=1)
            else:
                rows = flat.astype(np.uint8)
            data += _filtered(rows, max(1, samples * depth // 8), (first_filter + np.arange(len(part))) % 5)
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(x, zlib.crc32(kind)))
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlace)))
    if turn != 1:
        out += chunk(b"eXIf", b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, _TURN_TAG, 3, 1, turn, 0, 0))
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return out + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")
