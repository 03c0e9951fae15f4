"""Grey values of PNG files, as the PNG specification lays them down."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the specification: samples a pixel by colour type, and the seven passes of interlaced files as first
#: column, first row, column step, row step.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(raw: bytes) -> list[tuple[bytes, bytes]]:
    """(type, data) up to the end mark; a checksum that doesn't hold raises ValueError."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("no PNG file")
    out, at = [], len(SIGNATURE)
    while at + 12 <= len(raw):
        (size,) = struct.unpack_from(">I", raw, at)
        body = raw[at + 4 : at + 8 + size]
        if len(body) < size + 4 or struct.unpack_from(">I", raw, at + 8 + size)[0] != zlib.crc32(body):
            raise ValueError("broken chunk")
        out.append((body[:4], body[4:]))
        at += 12 + size
        if body[:4] == b"IEND":
            return out
    raise ValueError("no end mark")


def _rows(data: memoryview, height: int, width: int, back: int) -> np.ndarray:
    """Bytes of the rows with their filters undone; back is the distance to the same byte of the pixel before."""
    out = np.zeros((height + 1, width + back), np.uint8)  # a row above and a pixel to the left that are all 0
    for y in range(height):
        kind, line = data[y * (width + 1)], np.frombuffer(data, np.uint8, width, y * (width + 1) + 1)
        up, now = out[y], out[y + 1]
        if kind == 0:
            now[back:] = line
        elif kind == 2:
            now[back:] = line + up[back:]
        elif kind == 1:
            padded = np.zeros(-(-width // back) * back, np.uint8)
            padded[:width] = line
            now[back:] = np.cumsum(padded.reshape(-1, back), 0, dtype=np.uint8).ravel()[:width]
        elif kind in (3, 4):
            got, above = [0] * back + line.tolist(), up.tolist()
            for x in range(back, width + back):
                a, b = got[x - back], above[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[x - back]
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                got[x] = (got[x] + guess) & 255
            now[:] = got
        else:
            raise ValueError("unknown filter")
    return out[1:, back:]


def _samples(data: memoryview, h: int, w: int, depth: int, n: int) -> tuple[np.ndarray, int]:
    """(h, w, n) samples of one pass, and the bytes that it took."""
    if not (h and w):
        return np.zeros((h, w, n), np.uint16), 0
    width = (w * n * depth + 7) // 8
    rows = _rows(data, h, width, max(1, n * depth // 8))
    if depth == 16:
        flat = rows.reshape(h, -1, 2).astype(np.uint16)
        flat = flat[:, :, 0] << 8 | flat[:, :, 1]
    elif depth == 8:
        flat = rows.astype(np.uint16)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        flat = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint16)
    return flat[:, : w * n].reshape(h, w, n), h * (width + 1)


def grey(raw: bytes) -> np.ndarray:
    """(h, w) grey values 0..1. Alpha and transparent colours are left out; anything broken raises ValueError."""
    parts = chunks(raw)
    try:
        w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
        n = SAMPLES[kind]
        data = memoryview(zlib.decompress(b"".join(d for t, d in parts if t == b"IDAT")))
        if laced:
            px = np.zeros((h, w, n), np.uint16)
            for x, y, dx, dy in PASSES:
                got, used = _samples(data, max(0, -(-(h - y) // dy)), max(0, -(-(w - x) // dx)), depth, n)
                px[y::dy, x::dx], data = got, data[used:]
        else:
            px, _ = _samples(data, h, w, depth, n)
        top = (1 << depth) - 1
        if kind == 3:
            px, top = np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)[px[:, :, 0]], 255
    except (KeyError, IndexError, struct.error, zlib.error) as e:
        raise ValueError("broken PNG file") from e
    v = px.astype(float) / top
    return v @ np.array([0.299, 0.587, 0.114]) if kind == 3 else v[:, :, :3] @ np.array([0.299, 0.587, 0.114]) if n >= 3 else v[:, :, 0]
