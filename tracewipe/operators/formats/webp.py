"""WebP: RIFF chunks on the keep-list survive; animation frames are rebuilt from theirs."""

from __future__ import annotations

from ..model import EXIF, MAKER_NOTE, PROFILE, THUMBNAIL, TRAILER, UNKNOWN, XMP, Policy, Report, malformed
from . import exif
from .cursor import Cursor, number_at, printable

# Chunk types that draw the picture, within a frame, and what the known others are.
KEEP = frozenset((b"VP8 ", b"VP8L", b"VP8X", b"ALPH", b"ANIM", b"ANMF"))
FRAME_KEEP = frozenset((b"ALPH", b"VP8 ", b"VP8L"))
KIND = {b"EXIF": (EXIF, "EXIF"), b"XMP ": (XMP, "XMP"), b"ICCP": (PROFILE, "ICCP")}
FLAG_ICC, FLAG_EXIF, FLAG_XMP = 0x20, 0x08, 0x04
HEADER, FRAME_HEADER = 10, 16


def chunk(tag: bytes, body: bytes) -> bytes:
    return tag + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def _frame(body: bytes, report: Report) -> bytes:
    if len(body) < FRAME_HEADER:
        return body
    out, at = [body[:FRAME_HEADER]], FRAME_HEADER
    while at < len(body):
        size = number_at(body, at + 4, 4, "little")
        if size is None or at + 8 + size > len(body):
            break
        tag, sub = body[at : at + 4], body[at + 8 : at + 8 + size]
        if tag in FRAME_KEEP:
            out.append(chunk(tag, sub))
        else:
            report.drop(UNKNOWN, f"ANMF/{printable(tag)}", size)
        at = min(len(body), at + 8 + size + (size & 1))
    if at < len(body):
        report.drop(UNKNOWN, "ANMF trailing bytes", len(body) - at)
    return b"".join(out)


def chunks(data: bytes):
    c = Cursor(data, "WebP", 8)
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise malformed("WebP", "the RIFF header is missing")
    end = min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    c.at = 12
    while c.at < end:
        tag = c.take(4, "a chunk's type")
        body = c.take(c.number(4, "little", "a chunk's length"), f"chunk {printable(tag)}")
        c.at += len(body) & 1 if c.left() else 0
        yield tag, body


def clean(data: bytes, policy: Policy, report: Report) -> bytes:
    parts = list(chunks(data))
    end = 8 + int.from_bytes(data[4:8], "little")
    if end < len(data):
        report.drop(TRAILER, "after the RIFF payload", len(data) - end)
    out = []
    for tag, body in parts:
        if tag == b"ICCP" and policy.keep_profile:
            report.retain_profile()
            out.append(chunk(tag, body))
        elif tag == b"VP8X":
            mask = ~(FLAG_EXIF | FLAG_XMP | (0 if policy.keep_profile else FLAG_ICC)) & 0xFF
            out.append(chunk(tag, bytes((body[0] & mask,)) + body[1:HEADER] if body else body))
        elif tag == b"ANMF":
            out.append(chunk(tag, _frame(body, report)))
        elif tag in KEEP:
            out.append(chunk(tag, body))
        else:
            if tag == b"EXIF":
                found = exif.inspect(body)
                report.found_location |= found.gps
                if found.maker_note:
                    report.drop(MAKER_NOTE, "EXIF maker note", 0)
                if found.thumbnail:
                    report.drop(THUMBNAIL, "EXIF IFD1", 0)
            report.drop(*KIND.get(tag, (UNKNOWN, printable(tag))), len(body))
    if not out:
        raise malformed("WebP", "no image data")
    body = b"WEBP" + b"".join(out)
    return b"RIFF" + len(body).to_bytes(4, "little") + body
