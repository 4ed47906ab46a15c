"""A read-only look at a TIFF/EXIF block, and the blocks that may take its place."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .cursor import number_at

DEPTH = 4
SUB_DIRECTORIES = (0x8769, 0x8825, 0xA005)


@dataclass
class Findings:
    gps: bool = False
    maker_note: bool = False
    thumbnail: bool = False
    orientation: int | None = None


def byte_order(block: bytes) -> str | None:
    return {b"II": "little", b"MM": "big"}.get(block[:2])


def entries(block: bytes, at: int, order: str):
    """(tag, type, count, offset of the value field) of a directory, as far as it is whole."""
    n = number_at(block, at, 2, order)
    for i in range(n or 0):
        p = at + 2 + 12 * i
        tag, kind, count = number_at(block, p, 2, order), number_at(block, p + 2, 2, order), number_at(block, p + 4, 4, order)
        if count is None:
            return
        yield tag, kind, count, p + 8


def inspect(block: bytes) -> Findings:
    out = Findings()
    order = byte_order(block)
    if order is None or number_at(block, 2, 2, order) != 42:
        return out
    first = number_at(block, 4, 4, order)
    seen: set[int] = set()
    todo = [(first, 0)] if first is not None else []
    while todo:
        at, depth = todo.pop()
        if at in seen or depth > DEPTH:
            continue
        seen.add(at)
        for tag, kind, count, value in entries(block, at, order):
            if tag in (2, 4):
                out.gps = True
            elif tag == 0x927C:
                out.maker_note = True
            elif tag == 0x0112 and depth == 0 and kind == 3 and count == 1:
                v = number_at(block, value, 2, order)
                out.orientation = v if v is not None and 1 <= v <= 8 else out.orientation
            elif tag in SUB_DIRECTORIES and (sub := number_at(block, value, 4, order)) is not None:
                todo.append((sub, depth + 1))
    if first is not None and (n := number_at(block, first, 2, order)) is not None:
        out.thumbnail = bool(number_at(block, first + 2 + 12 * n, 4, order))
    return out


def orientation_block(value: int) -> bytes:
    """An APP1 payload that says nothing but which way is up (1 where out of range)."""
    v = value if 1 <= value <= 8 else 1
    return b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, v, 0, 0)


EMPTY_TIFF = b"MM\0*\0\0\0\0"
