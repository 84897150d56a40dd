"""PNG files of grey and colour images, 8 or 16 bits a value, without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Values a pixel has by the header's colour type (fixed by the format).
_VALUES = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(a: np.ndarray) -> bytes:
    """A 16-bit PNG of an image in [0, 1]: (h, w) grey or (3, h, w) colour."""
    v = (np.clip(a, 0, 1) * 65535 + 0.5).astype(">u2")
    colour = v.ndim == 3
    v = v.transpose(1, 2, 0) if colour else v
    h, w = v.shape[:2]
    raw = b"".join(b"\0" + line.tobytes() for line in v)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 2 if colour else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The image in [0, 1]: (h, w), or (channels, h, w); an alpha channel is left out."""
    at, body, head = len(MAGIC), b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] not in _VALUES or head[6]:
        raise ValueError("not a PNG of 8 or 16 bits without palette and interlacing")
    w, h, bits, colour = head[:4]
    n = _VALUES[colour]
    step = n * bits // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.uint8)
    for y, (how, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:], strict=True)):
        out[y] = above = _unfiltered(how, line, above, step)
    v = out.view(">u2" if bits == 16 else np.uint8).reshape(h, w, n).astype(np.float64) / (2**bits - 1)
    v = v[:, :, : n - 1 + n % 2]
    return v[:, :, 0] if v.shape[2] == 1 else v.transpose(2, 0, 1)


def _unfiltered(how: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line's bytes from their differences to the left, above, the mean of both, or the nearest of three."""
    if how == 0:
        return line
    if how == 2:
        return line + above
    if how == 1:
        return line.reshape(-1, step).cumsum(0, dtype=np.uint8).ravel()
    left, corner, out = [0] * step, [0] * step, []
    for i, x in enumerate(line.tolist()):
        a, b, c = left[i % step], int(above[i]), corner[i % step]
        if how == 3:
            near = (a + b) // 2
        else:
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        left[i % step], corner[i % step] = (x + near) & 255, b
        out.append(left[i % step])
    return np.array(out, np.uint8)
