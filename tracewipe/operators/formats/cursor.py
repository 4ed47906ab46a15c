"""Bounds-checked reading: every failure is an error of the file, never of the program."""

from __future__ import annotations

from ..model import malformed


class Cursor:
    def __init__(self, data: bytes, format: str, at: int = 0, end: int | None = None):
        self.data, self.format, self.at = data, format, at
        self.end = len(data) if end is None else min(end, len(data))

    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int, what: str) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise malformed(self.format, f"{what} ends before its {n} bytes")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int, order: str, what: str) -> int:
        return int.from_bytes(self.take(n, what), order)


def number_at(data: bytes, at: int, n: int, order: str) -> int | None:
    """An unsigned integer, or None where it is not whole."""
    raw = data[at : at + n] if at >= 0 else b""
    return int.from_bytes(raw, order) if len(raw) == n else None


def printable(tag: bytes) -> str:
    """A four-letter code for a report; other bytes as \\xNN."""
    return "".join(chr(c) if 32 <= c < 127 else f"\\x{c:02x}" for c in tag)
