"""Orientation of pictures: what a JPEG says of it, and turning pixels by it."""

from __future__ import annotations

import struct

import numpy as np

from ..functions.udfs import arrow_udf

UPRIGHT = 1


def orientation(data: bytes | None) -> int:
    """EXIF orientation, 1 to 8; 1 for anything that is missing or out of shape."""
    if not data or data[:2] != b"\xff\xd8":
        return UPRIGHT
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (0x01, 0xD8) or 0xD0 <= marker <= 0xD7:  # nothing belongs to them
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if marker in (0xD9, 0xDA) or size < 2 or at + 2 + size > len(data):
            break
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            return _from_tiff(body[6:])
        at += 2 + size
    return UPRIGHT


def _from_tiff(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return UPRIGHT
    magic, first = struct.unpack_from(f"{order}HI", tiff, 2)
    if magic != 42 or first + 2 > len(tiff):
        return UPRIGHT
    n = struct.unpack_from(f"{order}H", tiff, first)[0]
    if first + 2 + 12 * n > len(tiff):
        return UPRIGHT
    for i in range(n):
        tag, kind = struct.unpack_from(f"{order}HH", tiff, first + 2 + 12 * i)
        if tag == 0x0112 and kind == 3:
            value = struct.unpack_from(f"{order}H", tiff, first + 10 + 12 * i)[0]
            return value if 1 <= value <= 8 else UPRIGHT
    return UPRIGHT


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Rows and columns of a picture as its orientation means them."""
    if turn in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


@arrow_udf("int")
def jpeg_orientation(data):
    return orientation(bytes(data) if data is not None else None)


def coverage(rectangles: list[tuple[float, float, float, float]], page: tuple[float, float, float, float]) -> float:
    """Share of a page that the union of rectangles (left, bottom, right, top) covers; what lies outside is cut off."""
    left, bottom, right, top = page
    cut = [(max(a, left), max(b, bottom), min(c, right), min(d, top)) for a, b, c, d in rectangles]
    cut = [r for r in cut if r[0] < r[2] and r[1] < r[3]]
    xs, total = sorted({x for r in cut for x in (r[0], r[2])}), 0.0
    for a, b in zip(xs, xs[1:]):
        reach = bottom
        for _, low, _, high in sorted((r for r in cut if r[0] <= a and r[2] >= b), key=lambda r: r[1]):
            total += (b - a) * max(0.0, high - max(low, reach))
            reach = max(reach, high)
    area = (right - left) * (top - bottom)
    return total / area if area > 0 else 0.0


@arrow_udf("double")
def image_coverage(rectangles, page):
    """coverage() of columns: an array of structs of four doubles, and one such struct."""
    return coverage([tuple(r.values()) for r in rectangles or []], tuple(page.values())) if page is not None else 0.0
