"""GIF: pictures and palettes survive, two extensions in canonical form, nothing else."""

from __future__ import annotations

from ..model import COMMENT, TRAILER, UNKNOWN, XMP, Policy, Report, malformed
from .cursor import Cursor

LOOP = b"NETSCAPE2.0"
EXTENSIONS = {0xFE: (COMMENT, "comment extension"), 0x01: (UNKNOWN, "plain-text extension")}


def _palette(packed: int) -> int:
    return 3 << (packed & 7) + 1 if packed & 0x80 else 0


def _sub_blocks(c: Cursor) -> list[bytes]:
    out = []
    while n := c.number(1, "little", "a sub-block"):
        out.append(c.take(n, "a sub-block"))
    return out


def blocks(data: bytes):
    """("head" | "image" | label | "end" | "cut", raw bytes, sub-blocks) in order."""
    c = Cursor(data, "GIF")
    if c.take(6, "the header")[:3] != b"GIF":
        raise malformed("GIF", "not a GIF header")
    screen = c.take(7, "the screen descriptor")
    c.take(_palette(screen[4]), "the palette")
    yield "head", data[: c.at], []
    while c.left():
        start, mark = c.at, c.number(1, "little", "a block")
        if mark == 0x3B:
            yield "end", data[c.at :], []
            return
        if mark == 0x2C:
            c.take(_palette(c.take(9, "an image")[8]), "a palette")
            c.take(1, "an image")
            _sub_blocks(c)
            yield "image", data[start : c.at], []
        elif mark == 0x21:
            label = c.number(1, "little", "an extension")
            subs = _sub_blocks(c)
            yield label, data[start : c.at], subs
        else:
            raise malformed("GIF", f"no block starts with {mark:#04x}")
    yield "cut", b"", []


def clean(data: bytes, policy: Policy, report: Report) -> bytes:
    out, looped = [], False
    for what, raw, subs in blocks(data):
        size = sum(map(len, subs))
        if what in ("head", "image"):
            out.append(raw)
        elif what in ("end", "cut"):
            out.append(b"\x3b")
            if raw:
                report.drop(TRAILER, "after trailer", len(raw))
            if what == "cut":
                report.warnings.append("GIF_TRUNCATED")
        elif what == 0xF9:
            out.append(b"\x21\xf9\x04" + (subs[0] if subs else b"")[:4].ljust(4, b"\0") + b"\0")
            if size > 4 or len(subs) > 1:
                report.drop(UNKNOWN, "non-standard bytes in graphic-control extension", max(0, size - 4))
        elif what == 0xFF and subs and subs[0][:11] == LOOP and not looped:
            looped = True
            times = subs[1][1:3] if len(subs) > 1 and len(subs[1]) >= 3 and subs[1][0] == 1 else b"\0\0"
            out.append(b"\x21\xff\x0b" + LOOP + b"\x03\x01" + times + b"\0")
            if [len(s) for s in subs] != [11, 3]:
                report.drop(UNKNOWN, "non-standard bytes in NETSCAPE loop extension", max(0, size - 14))
        elif what == 0xFF:
            name = (subs[0][:11] if subs else b"").decode("utf-8", "replace")
            report.drop(XMP if "XMP" in name else UNKNOWN, f"application extension {name}", size)
        else:
            report.drop(*EXTENSIONS.get(what, (UNKNOWN, f"extension {what:#04x}")), size)
    return b"".join(out)
