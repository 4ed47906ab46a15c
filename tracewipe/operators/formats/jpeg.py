"""JPEG: markers that decode the picture survive, application segments are classified and go."""

from __future__ import annotations

from ..model import COMMENT, EXIF, IPTC, MAKER_NOTE, PROFILE, THUMBNAIL, TRAILER, UNKNOWN, XMP, Policy, Report, malformed
from . import exif

SOI, EOI, SOS, COM = 0xD8, 0xD9, 0xDA, 0xFE
STRUCTURAL = frozenset((*range(0xC0, 0xD0), *range(0xDB, 0xE0)))
BARE = frozenset((0x01, *range(0xD0, 0xD9)))  # markers without a length, ignored between segments

# Fixed values: (marker, prefix, letter case matters, class), the first that fits
APPLICATIONS = (
    (0xE0, b"JFIF\0", False, "jfif"), (0xE0, b"JFXX\0", False, "jfxx"), (0xE1, b"Exif\0", False, "exif"),
    (0xE1, b"http://ns.adobe.com/xap/1.0/\0", True, "xmp"), (0xE1, b"http://ns.adobe.com/xmp/extension/\0", True, "xmp"),
    (0xE2, b"ICC_PROFILE\0", True, "icc"), (0xE2, b"MPF\0", True, "mpf"), (0xED, b"Photoshop 3.0\0", True, "iptc"), (0xEE, b"Adobe", True, "adobe"),
)
VIDEO_SIGNS = (b"ftyp", b"MotionPh", b"Motion_P")
DROPPED = {"jfxx": (THUMBNAIL, "APP0 JFXX"), "xmp": (XMP, "APP1"), "iptc": (IPTC, "APP13 Photoshop/IPTC"), "mpf": (THUMBNAIL, "APP2 MPF")}


def classify(marker: int, payload: bytes) -> str:
    for m, prefix, exact, name in APPLICATIONS:
        head = payload[: len(prefix)]
        if m == marker and (head == prefix or not exact and head.lower() == prefix.lower()):
            return name
    return "other"


def segment(marker: int, payload: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(payload) + 2).to_bytes(2, "big") + payload


def entropy_end(data: bytes, at: int) -> int:
    """Where the scan that starts at ``at`` meets the next real marker (or the end)."""
    while (p := data.find(b"\xff", at)) >= 0 and p + 1 < len(data):
        nxt = data[p + 1]
        if nxt == 0xFF:
            at = p + 1
        elif nxt == 0 or 0xD0 <= nxt <= 0xD7:
            at = p + 2
        else:
            return p
    return p if p >= 0 else len(data)


def headers(data: bytes | bytearray, at: int = 0):
    """(marker, start, end) of the payloads before the first scan of the picture that starts at ``at``; what does not fit ends it."""
    at += 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != SOS:
        marker = data[at + 1]
        if marker in BARE or marker == EOI:
            at += 2
            continue
        start, at = at + 4, at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if at < start or at > len(data):
            return
        yield marker, start, at


def segments(data: bytes):
    """(marker, payload, scan data) in order; then (EOI, rest, b"") or, for a cut file, (None, b"", b"")."""
    if data[:2] != b"\xff\xd8":
        raise malformed("JPEG", "the start marker is missing")
    at, size = 2, len(data)
    while at < size:
        if data[at] != 0xFF:
            raise malformed("JPEG", f"no marker at offset {at}")
        while at < size and data[at] == 0xFF:
            at += 1
        if at == size:
            break
        marker = data[at]
        at += 1
        if marker == EOI:
            yield EOI, data[at:], b""
            return
        if marker in BARE:
            continue
        length = int.from_bytes(data[at : at + 2], "big")
        if at + 2 > size or length < 2 or at + length > size:
            raise malformed("JPEG", f"segment {marker:#04x} does not fit the file")
        payload, at = data[at + 2 : at + length], at + length
        scan = b""
        if marker == SOS:
            end = entropy_end(data, at)
            scan, at = data[at:end], end
        yield marker, payload, scan
    yield None, b"", b""


def _application(marker: int, payload: bytes, policy: Policy, report: Report) -> bytes:
    name, label = classify(marker, payload), f"APP{marker - 0xE0}"
    size = len(payload)
    if name in DROPPED:
        report.drop(*DROPPED[name], size)
    elif name == "jfif":
        if size < 14:
            report.drop(UNKNOWN, "APP0 malformed JFIF", size)
        else:
            if size > 14:
                report.drop(THUMBNAIL, "APP0 JFIF thumbnail", size - 14)
            return segment(marker, payload[:12] + b"\0\0")
    elif name == "adobe":
        if size < 12:
            report.drop(UNKNOWN, "APP14 short Adobe", size)
        else:
            if size > 12:
                report.drop(UNKNOWN, "APP14 Adobe tail", size - 12)
            return segment(marker, b"Adobe\0\x64\0\0\0\0" + payload[11:12])
    elif name == "icc":
        if policy.keep_profile:
            report.retain_profile()
            return segment(marker, payload)
        report.drop(PROFILE, "APP2 ICC_PROFILE", size)
    elif name == "exif":
        found = exif.inspect(payload[6:])
        report.found_location |= found.gps
        report.drop(EXIF, label, size)
        if found.maker_note:
            report.drop(MAKER_NOTE, "APP1 EXIF maker note", 0)
        if found.thumbnail:
            report.drop(THUMBNAIL, "APP1 EXIF IFD1", 0)
        if policy.keep_orientation and found.orientation is not None:
            return segment(marker, exif.orientation_block(found.orientation))
        if not policy.keep_orientation and found.orientation not in (None, 1):
            report.warnings.append("ORIENTATION_DROPPED")
    else:
        report.drop(UNKNOWN, label, size)
    return b""


def clean(data: bytes, policy: Policy, report: Report) -> bytes:
    out = [b"\xff\xd8"]
    for marker, payload, scan in segments(data):
        if marker is None:
            report.warnings.append("JPEG_TRUNCATED")
            out.append(b"\xff\xd9")
        elif marker == EOI:
            out.append(b"\xff\xd9")
            if payload and any(s in payload[:8192] for s in VIDEO_SIGNS):
                report.drop(THUMBNAIL, "embedded video (Motion Photo / Live Photo)", len(payload))
                report.warnings.append("JPEG_EMBEDDED_VIDEO")
            elif payload:
                report.drop(TRAILER, "after EOI", len(payload))
        elif marker == SOS or marker in STRUCTURAL:
            out += [segment(marker, payload), scan]
        elif marker == COM:
            report.drop(COMMENT, "COM", len(payload))
        elif 0xE0 <= marker <= 0xEF:
            out.append(_application(marker, payload, policy, report))
        else:
            report.drop(UNKNOWN, f"marker {marker:#04x}", len(payload))
    return b"".join(out)
