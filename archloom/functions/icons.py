"""Icons: sizes, ranking and choice."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BEST = 48


@dataclass(frozen=True)
class Icon:
    url: str
    width: int
    height: int
    content: bytes
    format: str


def rank(width: int, height: int) -> tuple[bool, int]:
    """Larger is better: a shorter side of 48 before all, then the longest shorter side."""
    side = min(width, height)
    return side == BEST, side


def ordered(icons: list[Icon]) -> list[Icon]:
    """Best first; equals in the order they came."""
    return sorted(icons, key=lambda i: rank(i.width, i.height), reverse=True)


def rank_columns(width: Column, height: Column) -> list[Column]:
    """Sort keys of the same order."""
    side = F.least(width, height)
    return [(side == BEST).desc(), side.desc()]


def probe(content: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the header; None if it is no known image. An SVG counts as 48 by 48."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return "PNG", *struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return "GIF", *struct.unpack("<HH", content[6:10])
    if content[:4] == b"\x00\x00\x01\x00" and len(content) >= 8:
        n = struct.unpack("<H", content[4:6])[0]
        sizes = [(content[6 + 16 * i] or 256, content[7 + 16 * i] or 256) for i in range(n) if len(content) >= 22 + 16 * i]
        return ("ICO", *max(sizes)) if sizes else None
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return "BMP", w, abs(h)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and content[12:16] == b"VP8X":
        return "WEBP", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            kind, n = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if kind in (0xC0, 0xC1, 0xC2, 0xC3):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + n
        return None
    if re.match(rb"\s*(?:<\?xml[^>]*>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<svg[\s>]", content[:4096], re.S):
        return "SVG", BEST, BEST
    return None
