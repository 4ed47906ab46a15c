"""TIFF: every page's directory is written anew from kept tags, with its pixel blocks copied."""

from __future__ import annotations

import struct

from ..model import AUTHOR, BEST_EFFORT, DOCUMENT, EXIF, IPTC, NONE, PROFILE, THUMBNAIL, TIMESTAMP, UNKNOWN, XMP, Policy, Report, malformed
from .cursor import number_at
from .exif import byte_order, entries

MOST_PAGES = 256
WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
# Tags that describe the picture itself, and the names of well-known others.
KEEP = frozenset((254, 255, 256, 257, 258, 259, 262, 263, 266, 277, 278, 282, 283, 284, 296, 317, 320, 322, 323, 338, 339, 347))
DATA = {273: 279, 324: 325}  # tag of block offsets: tag of block sizes
ORIENTATION, ICC, GPS = 274, 34675, 34853
LABELS = {
    270: (DOCUMENT, "image description"), 271: (EXIF, "camera make"), 272: (EXIF, "camera model"), 305: (EXIF, "software"), 306: (TIMESTAMP, "date/time"),
    315: (AUTHOR, "artist"), 316: (EXIF, "host computer"), 33432: (EXIF, "copyright"), 700: (XMP, "XMP"), 33723: (IPTC, "IPTC"),
    34377: (EXIF, "Photoshop resources"), 34665: (EXIF, "Exif sub-directory"), 37724: (EXIF, "layered image data"),
}
RAW_TAGS = frozenset((330, 33421, 33422, 50706))
RAW_PHOTOMETRIC = frozenset((32803, 34892))


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.order = data, byte_order(data)

    def value(self, entry) -> bytes | None:
        """The entry's raw bytes, in the field itself or where it points."""
        _, kind, count, at = entry
        n = WIDTH.get(kind, 0) * count
        if not n:
            return None
        if n > 4 and (at := number_at(self.data, at, 4, self.order)) is None:
            return None
        raw = self.data[at : at + n]
        return raw if len(raw) == n else None

    def numbers(self, entry) -> list[int] | None:
        raw, w = self.value(entry), WIDTH.get(entry[1], 0)
        if raw is None or entry[1] not in (1, 3, 4, 13):
            return None
        return [int.from_bytes(raw[i : i + w], self.order) for i in range(0, len(raw), w)]

    def first(self, page: dict, tag: int) -> int | None:
        return (self.numbers(page[tag]) or [None])[0] if tag in page else None


def pages(data: bytes) -> list[list[tuple[int, int, int, int]]]:
    """The directories of the chain, each a list of its entries; a loop ends it."""
    order = byte_order(data)
    if len(data) < 8 or order is None or number_at(data, 2, 2, order) != 42:
        raise malformed("TIFF", "not a TIFF header")
    out, seen, at = [], set(), number_at(data, 4, 4, order)
    while at and at not in seen and len(out) < MOST_PAGES:
        seen.add(at)
        n = number_at(data, at, 2, order)
        after = None if n is None else number_at(data, at + 2 + 12 * n, 4, order)
        if after is None:
            raise malformed("TIFF", "a directory does not fit the file")
        out.append(list(entries(data, at, order)))
        at = after
    if not out:
        raise malformed("TIFF", "there is no directory")
    return out


def _kept(r: _Reader, page: list, policy: Policy, report: Report) -> tuple[list[tuple[int, int, int, bytes]], int]:
    """(tag, type, count, bytes) of entries that stay and need no new offsets; number of nameless drops."""
    out, nameless = [], 0
    for entry in page:
        tag = entry[0]
        stays = tag in KEEP or tag == ORIENTATION and policy.keep_orientation or tag == ICC and policy.keep_profile
        if tag in DATA or tag in DATA.values():
            continue
        if stays:
            if tag == ICC:
                report.retain_profile()
            if (raw := r.value(entry)) is not None:
                out.append((tag, entry[1], entry[2], raw))
        elif tag == ORIENTATION:
            report.drop(EXIF, "TIFF tag: orientation", 0)
        elif tag == ICC:
            report.drop(PROFILE, "TIFF tag: ICC profile", 0)
        elif tag == GPS:
            report.found_location = True
            report.drop(EXIF, "GPS sub-directory", 0)
        elif tag in LABELS:
            kind, name = LABELS[tag]
            report.drop(kind, f"TIFF tag: {name}", 0)
        else:
            nameless += 1
    return out, nameless


def _blocks(r: _Reader, page: list) -> tuple[int, list[bytes]]:
    """The tag of the block offsets and the blocks, offsets and sizes joined by position."""
    by_tag = {e[0]: e for e in page}
    for where, sizes in DATA.items():
        if where in by_tag and sizes in by_tag:
            at, n = r.numbers(by_tag[where]), r.numbers(by_tag[sizes])
            if not at or not n or len(at) != len(n):
                raise malformed("TIFF", "pixel offsets and sizes do not match")
            out = [r.data[a : a + k] for a, k in zip(at, n, strict=True)]
            if any(len(b) != k for b, k in zip(out, n, strict=True)):
                raise malformed("TIFF", "a pixel block lies outside the file")
            return where, out
    raise malformed("TIFF", "a directory has no pixel blocks")


def _write(order: str, start: int, kept: list, where: int, blocks: list[bytes]) -> tuple[bytes, int]:
    """A directory at ``start`` with its values and blocks behind it; and where its link to the next is."""
    e = "<" if order == "little" else ">"
    fields = [*kept, (DATA[where], 4, len(blocks), struct.pack(f"{e}{len(blocks)}I", *map(len, blocks))), (where, 4, len(blocks), None)]
    fields.sort(key=lambda f: f[0])
    at = start + 2 + 12 * len(fields) + 4
    link = at - 4
    placed: dict[int, int] = {}
    for i, (_, _, n, raw) in enumerate(fields):
        size = 4 * n if raw is None else len(raw)
        if size > 4:
            at += at & 1
            placed[i], at = at, at + size
    offsets = []
    for b in blocks:
        at += at & 1
        offsets.append(at)
        at += len(b)
    if at > 2**32 - 1:
        raise malformed("TIFF", "the rebuilt file would be too large")
    out = bytearray(at - start)
    struct.pack_into(f"{e}H", out, 0, len(fields))
    for i, (tag, kind, n, raw) in enumerate(fields):
        raw = struct.pack(f"{e}{n}I", *offsets) if raw is None else raw
        p = 2 + 12 * i
        struct.pack_into(f"{e}HHI", out, p, tag, kind, n)
        if i in placed:
            struct.pack_into(f"{e}I", out, p + 8, placed[i])
            out[placed[i] - start : placed[i] - start + len(raw)] = raw
        else:
            out[p + 8 : p + 8 + len(raw)] = raw
    for b, o in zip(blocks, offsets, strict=True):
        out[o - start : o - start + len(b)] = b
    return bytes(out), link


def clean(data: bytes, policy: Policy, report: Report) -> bytes:
    chain, r = pages(data), _Reader(data)
    first = {e[0]: e for e in chain[0]}
    if RAW_TAGS & first.keys() or r.first(first, 262) in RAW_PHOTOMETRIC:
        report.weaken(NONE)
        report.warnings.append("TIFF_LOOKS_RAW")
        return data
    out, nameless, link = bytearray(data[:4] + b"\0\0\0\0"), 0, 4
    e = "<" if r.order == "little" else ">"
    for number, page in enumerate(chain):
        by_tag = {x[0]: x for x in page}
        if number and ((r.first(by_tag, 254) or 0) & 1 or r.first(by_tag, 255) == 2):
            report.drop(THUMBNAIL, "reduced-resolution page", 0)
            continue
        if r.first(by_tag, 259) in (6, 7) and "TIFF_JPEG_STRIPS" not in report.warnings:
            report.weaken(BEST_EFFORT)
            report.warnings.append("TIFF_JPEG_STRIPS")
        kept, n = _kept(r, page, policy, report)
        nameless += n
        out += b"\0" * (len(out) & 1)
        struct.pack_into(f"{e}I", out, link, len(out))
        raw, link = _write(r.order, len(out), kept, *_blocks(r, page))
        out += raw
    if nameless:
        report.drop(UNKNOWN, f"{nameless} non-structural tag(s)", 0)
    return bytes(out)
