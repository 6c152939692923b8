"""Kind and size of images by their first bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def size(data: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height) of PNG, JPEG, GIF and BMP data, else None."""
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data.startswith(b"BM"):
            w, h = struct.unpack("<ii", data[18:26])
            return ("bmp", w, abs(h))
        if data.startswith(b"\xff\xd8"):
            at = 2
            while at + 9 <= len(data):
                marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return ("jpeg", w, h)
                at += 2 + length
    except struct.error:
        pass
    return None


# Samples of a pixel by PNG colour type; the grey below which a pixel is ink, and the opacity
# below which it is none.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
INK, OPAQUE = 192, 16


def pixels(data: bytes) -> tuple[np.ndarray, int, np.ndarray | None]:
    """Samples (height, width, samples) of an 8-bit PNG without interlace, its colour type and palette."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise ValueError("not a PNG")
    at, packed, palette = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body, at = data[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if bits != 8 or interlace or colour not in SAMPLES:
        raise ValueError("a PNG of another form")
    step = SAMPLES[colour]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, row = lines[y, 0], lines[y, 1:]
        if kind == 1:
            row = np.add.accumulate(row.reshape(width, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            row = _slanted(row, above, step, kind)
        out[y] = above = row
    return out.reshape(height, width, step), colour, palette


def _slanted(row: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    """The filters that look left and up at once."""
    out = [0] * len(row)
    for i, (x, up) in enumerate(zip(row.tolist(), above.tolist())):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            near = (left + up) // 2
        else:
            corner = int(above[i - step]) if i >= step else 0
            guess = left + up - corner
            near = min((left, up, corner), key=lambda v: abs(guess - v))
        out[i] = x + near & 255
    return np.array(out, np.uint8)


def ink(data: bytes) -> float:
    """The share of a picture's pixels that are dark; transparent ones are not."""
    x, colour, palette = pixels(data)
    if colour == 3 and palette is not None:
        grey = palette[np.minimum(x[:, :, 0], len(palette) - 1)].mean(axis=2)
    else:
        grey = x[:, :, : 3 if x.shape[2] >= 3 else 1].mean(axis=2)
    dark = grey < INK
    if x.shape[2] in (2, 4):
        dark &= x[:, :, -1] >= OPAQUE
    return float(dark.mean()) if dark.size else 0.0
