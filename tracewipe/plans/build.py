"""Containers built around a row's text as Spark expressions, so that what a scrub must find is known."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.formats import jpeg, png

PIXEL = [png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), png.chunk(b"IDAT", zlib.compress(b"\0\0")), png.chunk(b"IEND", b"")]
BARE_PNG = png.MAGIC + b"".join(PIXEL)
JPEG_HEAD = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
JPEG_TAIL = jpeg.segment(0xDB, bytes(65)) + jpeg.segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\0\x34" + b"\xff\xd9"
GIF_HEAD = b"GIF89a\1\0\1\0\0\0\0"
GIF_TAIL = b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x4c\1\0" + b"\x3b"


def text_bytes() -> Column:
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8")


def be(n: Column, width: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def le(n: Column, width: int = 4) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)]))


def lit(b: bytes) -> Column:
    return F.lit(bytes(b))


def png_chunk(tag: bytes, body: Column) -> Column:
    return F.concat(be(F.length(body)), lit(tag), body, be(F.crc32(F.concat(lit(tag), body))))


def png_with(extra: Column, trailer: Column | None = None) -> Column:
    """A one-pixel PNG with chunks after its header and bytes after its end."""
    parts = [lit(png.MAGIC + PIXEL[0]), extra, lit(PIXEL[1] + PIXEL[2])]
    return F.concat(*parts, *([trailer] if trailer is not None else []))


def _cut(body: Column, size: int, head: str, last) -> Column:
    """The body in pieces of ``size`` bytes, each behind ``head``; ``last`` heads the rest, if there is one."""
    h = F.hex(body)
    whole = F.floor(F.length(body) / size).cast("int") * size
    rest = F.length(body) - whole
    full = F.regexp_replace(F.substring(h, F.lit(1), 2 * whole), f"(.{{{2 * size}}})", f"{head}$1")
    tail = F.when(rest > 0, F.concat(last(rest), F.substring(h, 2 * whole + 1, 2 * rest))).otherwise("")
    return F.unhex(F.concat(full, tail))


def jpeg_with_comments(body: Column) -> Column:
    """A JPEG with the body in as many comment segments as it needs."""
    return F.concat(lit(JPEG_HEAD), _cut(body, 65_533, "FFFEFFFF", lambda n: F.concat(F.lit("FFFE"), F.lpad(F.hex(n + 2), 4, "0"))), lit(JPEG_TAIL))


def jpeg_segment(marker: int, payload: Column) -> Column:
    return F.concat(lit(bytes((0xFF, marker))), be(F.length(payload) + 2, 2), payload)


def gif_with_comment(body: Column) -> Column:
    blocks = _cut(body, 255, "FF", lambda n: F.lpad(F.hex(n), 2, "0"))
    return F.concat(lit(GIF_HEAD + b"\x21\xfe"), blocks, lit(b"\0" + GIF_TAIL))


def riff_chunk(tag: bytes, body: Column) -> Column:
    return F.concat(lit(tag), le(F.length(body)), body, F.when(F.length(body) % 2 == 1, lit(b"\0")).otherwise(lit(b"")))


def webp_with(extra: Column) -> Column:
    body = F.concat(lit(b"WEBP"), lit(b"VP8 \4\0\0\0\1\2\3\4"), extra)
    return F.concat(lit(b"RIFF"), le(F.length(body)), body)


STRIP = b"\x10\x20\x30\x40"


def tiff_with(tag: int, value: Column, version: bool = False, cover: Column | None = None) -> Column:
    """A one-pixel TIFF with ``value`` (more than 4 bytes of text) under ``tag``.

    ``version`` makes it a raw; where ``cover`` is true the pixel block's size reaches over the value.
    """
    fixed = [(256, 3, 1, 1), (257, 3, 1, 1), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (277, 3, 1, 1), (278, 3, 1, 1)]
    if version:
        fixed.append((0xC612, 1, 4, 0x0401))
    n = len(fixed) + 3
    strip = 8 + 2 + 12 * n + 4
    at = strip + len(STRIP)
    size = F.lit(len(STRIP)) if cover is None else F.when(cover, F.length(value) + len(STRIP)).otherwise(len(STRIP))
    rows = {t: lit(struct.pack("<HHII", t, k, c, v)) for t, k, c, v in fixed}
    rows[273] = lit(struct.pack("<HHII", 273, 4, 1, strip))
    rows[279] = F.concat(lit(struct.pack("<HHI", 279, 4, 1)), le(size))
    rows[tag] = F.concat(lit(struct.pack("<HH", tag, 2)), le(F.length(value)), lit(struct.pack("<I", at)))
    return F.concat(lit(b"II*\0" + struct.pack("<IH", 8, n)), *[rows[t] for t in sorted(rows)], lit(b"\0\0\0\0" + STRIP), value)


def _box(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + tag + body


def heif_with_exif(item: Column) -> Column:
    """A HEIF file whose item 1 is the given EXIF data and whose item 2 has no place in the file."""
    ftyp = _box(b"ftyp", b"heic\0\0\0\0mif1heic")
    infe = b"".join(_box(b"infe", b"\2\0\0\0" + struct.pack(">HH", i, 0) + b"Exif\0") for i in (1, 2))
    iinf = _box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 2) + infe)
    iloc = b"\1\0\0\0\x44\0" + struct.pack(">H", 1) + struct.pack(">HHHH", 1, 0, 0, 1)
    meta = 8 + 4 + len(iinf) + 8 + len(iloc) + 8
    at = len(ftyp) + meta + 8
    head = ftyp + struct.pack(">I", meta) + b"meta\0\0\0\0" + iinf + struct.pack(">I", 8 + len(iloc) + 8) + b"iloc" + iloc
    return F.concat(lit(head + struct.pack(">I", at)), be(F.length(item)), be(F.length(item) + 8), lit(b"mdat"), item)


def zip_stored(members: list[tuple[str, Column]]) -> Column:
    """An archive of stored members with a real time stamp in their headers."""
    local, central, at = [], [], F.lit(0)
    for name, body in members:
        raw = name.encode()
        facts = F.concat(lit(struct.pack("<HHHHH", 20, 0, 0, 0x6A2B, 0x58C9)), le(F.crc32(body)), le(F.length(body)), le(F.length(body)), lit(struct.pack("<HH", len(raw), 0)))
        local += [lit(b"PK\3\4"), facts, lit(raw), body]
        central += [lit(b"PK\1\2" + struct.pack("<H", 0x031E)), facts, lit(bytes(10)), le(at), lit(raw)]
        at = at + 30 + len(raw) + F.length(body)
    directory = F.concat(*central)
    end = F.concat(lit(b"PK\5\6" + struct.pack("<HHHH", 0, 0, len(members), len(members))), le(F.length(directory)), le(at), lit(b"\0\0"))
    return F.concat(*local, directory, end)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def docx_with(creator: Column, picture: Column | None = None) -> Column:
    core = F.encode(F.concat(F.lit("<cp:coreProperties><dc:creator>"), escaped(creator), F.lit("</dc:creator></cp:coreProperties>")), "UTF-8")
    parts = [("[Content_Types].xml", lit(b"<Types/>")), ("docProps/core.xml", core), ("word/document.xml", lit(b"<w:document><w:p/></w:document>"))]
    return zip_stored(parts + ([("word/media/image1.png", picture)] if picture is not None else []))


def pdf_with(author: Column) -> Column:
    head = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1>>\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R>>\nendobj\n4 0 obj\n<</Author<"
    return F.concat(lit(head), F.encode(F.hex(author), "UTF-8"), lit(b">/CreationDate(D:2020)>>\nendobj\ntrailer\n<</Root 1 0 R/Info 4 0 R/ID[<aa><bb>]>>\n"))


def xmp_with(text: Column) -> Column:
    return F.concat(lit(b'<?xpacket begin=""?><x:xmpmeta xmlns:x="adobe:ns:meta/">'), F.encode(escaped(text), "UTF-8"), lit(b'</x:xmpmeta><?xpacket end="w"?>'))
