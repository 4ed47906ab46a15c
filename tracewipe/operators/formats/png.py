"""PNG: chunks on the keep-list survive with their checksum verified; all else goes."""

from __future__ import annotations

import zlib

from ..model import COMMENT, EXIF, MAKER_NOTE, PROFILE, TIMESTAMP, TRAILER, UNKNOWN, XMP, Policy, Report, malformed
from . import exif
from .cursor import Cursor, printable

MAGIC = b"\x89PNG\r\n\x1a\n"
# Chunk types that draw the picture, and what the known others are.
KEEP = frozenset((b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"sBIT", b"bKGD", b"pHYs", b"hIST", b"acTL", b"fcTL", b"fdAT"))
KIND = {b"tEXt": COMMENT, b"zTXt": COMMENT, b"iTXt": XMP, b"eXIf": EXIF, b"tIME": TIMESTAMP, b"iCCP": PROFILE}
MOST = 2**31 - 1


def chunks(data: bytes):
    """(type, body, whole chunk) up to and with IEND; then (None, trailing bytes, b"") if there are any."""
    c = Cursor(data, "PNG", 8)
    if data[:8] != MAGIC:
        raise malformed("PNG", "the signature is missing")
    tag = b""
    while tag != b"IEND":
        if not c.left():
            raise malformed("PNG", "there is no IEND chunk")
        start = c.at
        size = c.number(4, "big", "a chunk's length")
        if size > MOST:
            raise malformed("PNG", f"a chunk of {size} bytes is beyond the limit")
        tag = c.take(4, "a chunk's type")
        body = c.take(size, f"chunk {printable(tag)}")
        c.take(4, f"the checksum of {printable(tag)}")
        yield tag, body, data[start : c.at]
    if c.left():
        yield None, data[c.at :], b""


def clean(data: bytes, policy: Policy, report: Report) -> bytes:
    keep = KEEP | {b"iCCP"} if policy.keep_profile else KEEP
    out = [MAGIC]
    for tag, body, whole in chunks(data):
        if tag is None:
            report.drop(TRAILER, "after IEND", len(body))
        elif tag in keep:
            if zlib.crc32(tag + body) != int.from_bytes(whole[-4:], "big"):
                raise malformed("PNG", f"the checksum of {printable(tag)} is wrong")
            if tag == b"iCCP":
                report.retain_profile()
            out.append(whole)
        else:
            report.drop(KIND.get(tag, UNKNOWN), printable(tag), len(body))
            if tag == b"eXIf":
                found = exif.inspect(body)
                report.found_location |= found.gps
                if found.maker_note:
                    report.drop(MAKER_NOTE, "eXIf maker note", 0)
    return b"".join(out)


def chunk(tag: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + tag + body + zlib.crc32(tag + body).to_bytes(4, "big")
