"""PNG bytes to RGB arrays and back, with the standard library and numpy: 8-bit, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(rgb: np.ndarray) -> bytes:
    height, width, _ = rgb.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1).astype(np.uint8)], 1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            line = np.add.accumulate(line.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(stride):
                a, b = int(line[x - step]) if x >= step else 0, int(above[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = int(above[x - step]) if x >= step else 0
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    return out


def decode(content: bytes) -> np.ndarray:
    """RGB, transparency laid over white."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, palette, alpha, head = 8, b"", None, None, None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            data += body
    width, height, depth, form, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG images that are not interlaced are read")
    channels = _CHANNELS[form]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, -1)
    values = _unfilter(raw, height, width * channels, channels).reshape(height, width, channels)
    if form == 3:
        see = np.full(len(palette), 255, np.uint8)
        if alpha:
            see[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        values = np.concatenate([palette, see[:, None]], 1)[values[..., 0]]
    elif form in (0, 4):
        values = np.concatenate([np.repeat(values[..., :1], 3, 2), values[..., 1:]], 2)
    return over_white(values)


def over_white(values: np.ndarray) -> np.ndarray:
    if values.shape[2] == 3:
        return values
    a = values[..., 3:].astype(float) / 255
    return np.rint(a * values[..., :3] + (1 - a) * 255).astype(np.uint8)
