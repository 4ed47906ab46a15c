"""HEIF and AVIF: metadata items are found through two tables and overwritten where they lie."""

from __future__ import annotations

from ..model import BEST_EFFORT, EXIF, MAKER_NOTE, THUMBNAIL, XMP, Policy, Report, ScrubError, malformed
from . import exif
from .cursor import Cursor, number_at

MOST_BOXES = MOST_ITEMS = 4096
# Fixed values
XMP_UUID = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
EMPTY_XMP = b'<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"/><?xpacket end="w"?>'
IN_FILE, IN_IDAT = 0, 1


def boxes(data: bytes, at: int, end: int, most: int = MOST_BOXES):
    """(type, start of body, end) of sibling boxes, as far as they are whole."""
    out = []
    end = min(end, len(data))
    while at + 8 <= end:
        size, tag, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = number_at(data, at + 8, 8, "big"), 16
            if size is None:
                break
        elif size == 0:
            size = end - at
        if size < head:
            raise malformed("HEIF", f"a box of {size} bytes")
        if len(out) >= most:
            raise malformed("HEIF", "too many boxes")
        out.append((tag, at + head, min(at + size, end)))
        at += size
    return out


def _find(siblings: list, tag: bytes):
    return next(((body, end) for t, body, end in siblings if t == tag), None)


def items(data: bytes, children: list, report: Report) -> list[tuple[int, str]]:
    """(item id, EXIF or XMP) from the item table."""
    span = _find(children, b"iinf")
    if span is None:
        return []
    out = []
    try:
        c = Cursor(data, "HEIF", span[0], span[1])
        version = c.take(4, "iinf")[0]
        if c.number(2 if version == 0 else 4, "big", "iinf") > MOST_ITEMS:
            report.warnings.append("HEIF_TABLE_IMPLAUSIBLE")
            return []
        for tag, body, end in boxes(data, c.at, span[1]):
            if tag != b"infe":
                continue
            e = Cursor(data, "HEIF", body, end)
            try:
                version = e.take(4, "infe")[0]
                if version not in (2, 3):
                    continue
                number = e.number(2 if version == 2 else 4, "big", "infe")
                e.take(2, "infe")
                kind = e.take(4, "infe")
            except ScrubError:
                continue
            if kind == b"Exif":
                out.append((number, EXIF))
            elif kind == b"mime":
                fields = data[e.at : end].split(b"\0")
                if len(fields) > 1 and fields[1].startswith(b"application/rdf+xml"):
                    out.append((number, XMP))
    except ScrubError:
        return []
    return out


def locations(data: bytes, children: list, report: Report) -> dict[int, list[tuple[int, int, int]]]:
    """Item id: (construction method, offset, length) of each extent; what was read before a defect stays."""
    span, out = _find(children, b"iloc"), {}
    if span is None:
        return out
    try:
        c = Cursor(data, "HEIF", span[0], span[1])
        version = c.take(4, "iloc")[0]
        sizes = c.number(2, "big", "iloc")
        w_offset, w_length, w_base, w_index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15

        def sized(w: int) -> int:
            if w not in (0, 4, 8):
                raise malformed("HEIF", f"a field of {w} bytes")
            return c.number(w, "big", "iloc") if w else 0

        w_id = 2 if version < 2 else 4
        count = c.number(w_id, "big", "iloc")
        if count > MOST_ITEMS:
            report.warnings.append("HEIF_TABLE_IMPLAUSIBLE")
            return {}
        for _ in range(count):
            number = c.number(w_id, "big", "iloc")
            method = c.number(2, "big", "iloc") & 15 if version in (1, 2) else IN_FILE
            c.take(2, "iloc")
            base, extents = sized(w_base), []
            for _ in range(c.number(2, "big", "iloc")):
                if version in (1, 2) and w_index:
                    sized(w_index)
                offset = sized(w_offset)
                extents.append((method, base + offset, sized(w_length)))
            out[number] = extents
    except ScrubError:
        pass
    return out


def _blank(kind: str, size: int) -> bytes:
    if kind == EXIF:
        empty = b"\0\0\0\0" + exif.EMPTY_TIFF
        return empty.ljust(size, b"\0") if size >= len(empty) else b"\0" * size
    return EMPTY_XMP.ljust(size) if size >= len(EMPTY_XMP) else b"\0" * size


def clean(data: bytes, policy: Policy, report: Report) -> bytes:
    report.weaken(BEST_EFFORT)
    top = boxes(data, 0, len(data))
    if _find(top, b"ftyp") is None:
        raise malformed("HEIF", "there is no ftyp box")
    out = bytearray(data)
    meta = _find(top, b"meta")
    if meta is None:
        report.warnings.append("HEIF_NO_META")
    else:
        children = boxes(data, min(meta[0] + 4, meta[1]), meta[1])
        where, idat, touched = locations(data, children, report), _find(children, b"idat"), False
        if (iprp := _find(children, b"iprp")) and (ipco := _find(boxes(data, *iprp), b"ipco")):
            if any(t == b"colr" and data[b : b + 4] in (b"prof", b"rICC") for t, b, _ in boxes(data, *ipco)):
                report.retain_profile()
        for number, kind in items(data, children, report):
            if number not in where:
                report.warnings.append("HEIF_ITEM_NO_LOCATION")
            for method, offset, size in where.get(number, ()):
                if method not in (IN_FILE, IN_IDAT):
                    report.warnings.append("HEIF_ITEM_IN_ITEM")
                    continue
                if method == IN_IDAT and idat is None:
                    report.warnings.append("HEIF_NO_IDAT")
                    continue
                start = offset + (idat[0] if method == IN_IDAT else 0)
                if not 0 < size <= len(data) - start:
                    report.warnings.append("HEIF_RANGE_OUTSIDE")
                    continue
                if kind == EXIF and (skip := number_at(bytes(out[start : start + 4]), 0, 4, "big")) is not None and size >= 4:
                    found = exif.inspect(bytes(out[start + 4 + skip : start + size]))
                    report.found_location |= found.gps
                    if found.maker_note:
                        report.drop(MAKER_NOTE, "meta EXIF maker note", 0)
                    if found.thumbnail:
                        report.drop(THUMBNAIL, "meta EXIF IFD1", 0)
                report.drop(kind, f"meta item {number}", size)
                out[start : start + size] = _blank(kind, size)
                touched = True
        if touched:
            report.warnings.append("HEIF_OVERWRITTEN")
    for tag, body, end in top:
        if tag == b"uuid" and data[body : body + 16] == XMP_UUID and body + 16 < end:
            report.drop(XMP, "uuid XMP box", end - body - 16)
            out[body + 16 : end] = b" " * (end - body - 16)
    return bytes(out)
