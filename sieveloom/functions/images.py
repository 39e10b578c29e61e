"""Image headers: size after orientation and alpha, without decoding pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("alpha", T.BooleanType())


def _png(b: bytes) -> tuple[int, int, bool]:
    width, height = struct.unpack(">II", b[16:24])
    return width, height, b[25] in (4, 6) or b"tRNS" in b[:1024]


def _webp(b: bytes) -> tuple[int, int, bool]:
    kind = b[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), bool(b[20] & 16)
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)
    width, height = struct.unpack("<HH", b[26:30])
    return width & 0x3FFF, height & 0x3FFF, False


def _orientation(exif: bytes) -> int:
    """The orientation tag of an Exif block, 1 if there is none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 10:
        return 1
    at = struct.unpack(order + "I", exif[4:8])[0]
    for i in range(struct.unpack(order + "H", exif[at : at + 2])[0]):
        tag, _, _, value = struct.unpack(order + "HHIH", exif[at + 2 + 12 * i : at + 12 + 12 * i])
        if tag == 0x112:
            return value
    return 1


def _jpeg(b: bytes) -> tuple[int, int, bool]:
    at, turned = 2, False
    while at + 9 < len(b):
        marker, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
        if marker == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
            turned = _orientation(b[at + 10 : at + 2 + size]) in (5, 6, 7, 8)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return (height, width, False) if turned else (width, height, False)
        at += 2 + size
    raise ValueError("no frame header")


def probe(content: bytes) -> tuple[int | None, int | None, bool | None]:
    """(width, height, alpha) of PNG, WebP, JPEG, GIF or BMP bytes; nulls for anything else."""
    try:
        if content.startswith(b"\x89PNG\r\n\x1a\n"):
            return _png(content)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            return _webp(content)
        if content.startswith(b"\xff\xd8"):
            return _jpeg(content)
        if content[:3] == b"GIF":
            return (*struct.unpack("<HH", content[6:10]), False)
        if content[:2] == b"BM":
            width, height = struct.unpack("<ii", content[18:26])
            return width, abs(height), False
    except (struct.error, ValueError, IndexError):
        pass
    return None, None, None


@F.pandas_udf(HEADER)
def image_header(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in parts:
        yield pd.DataFrame([probe(bytes(b)) if b is not None else (None, None, None) for b in s], columns=["width", "height", "alpha"])
