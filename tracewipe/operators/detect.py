"""Format detection from leading bytes, as a Spark expression and for single files.

The first rule that fits wins; names and file endings are never looked at.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import prepare
from .formats import raw
from .formats.exif import byte_order

# Brands of the ISO base media family, most telling family first.
BRANDS = (
    ("AVIF", (b"avif", b"avis")),
    ("HEIF", (b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1")),
    ("audio", (b"M4A ", b"M4B ", b"F4A ", b"F4B ")),
    ("video", (b"isom", b"iso2", b"iso4", b"iso5", b"iso6", b"mp41", b"mp42", b"avc1", b"dash", b"M4V ", b"M4VH", b"M4VP", b"qt  ", b"3gp4", b"3gp5", b"3g2a", b"mmp4", b"f4v ")),
)
HEADS = (
    ("JPEG", b"\xff\xd8\xff"), ("PNG", b"\x89PNG\r\n\x1a\n"), ("RIFF", b"RIFF"), ("PDF", b"%PDF-"), ("video", b"\x1a\x45\xdf\xa3"), ("audio", b"OggS"), ("audio", b"fLaC"),
)
RIFF_KINDS = {b"WEBP": "WebP", b"AVI ": "video", b"WAVE": "audio"}
OPEN_DOCUMENT, OOXML = (b"mimetype",), (b"[Content_Types].xml", b"_rels/", b"word/", b"xl/", b"ppt/", b"docProps/")
SVG_SCAN, XMP_SCAN = 1024, 4096
UNKNOWN = "unknown format"


def _starts_xml(head: bytes) -> bool:
    h = head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n\f")
    return h.startswith((b"<?xml", b"<svg", b"<!--", b"<!DOCTYPE svg", b"<x:xmpmeta", b"<?xpacket", b"<rdf:RDF"))


def _brand(data: bytes) -> str | None:
    if len(data) < 12 or data[4:8] != b"ftyp":
        return None
    end = min(len(data), max(16, int.from_bytes(data[:4], "big")))
    found = {data[i : i + 4] for i in range(8, end - 3, 4)}
    return next((name for name, brands in BRANDS if found & set(brands)), None)


def _mp3(data: bytes) -> bool:
    return data[:3] == b"ID3" or len(data) > 1 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0 and data[1] & 0x18 != 8 and data[1] & 6 != 0


def _zip(data: bytes) -> str:
    n = int.from_bytes(data[26:28], "little")
    first = data[30 : 30 + n]
    if first in OPEN_DOCUMENT:
        return "OpenDocument" if b"opendocument" in data[30 + n : 30 + n + 200] else "ZIP"
    return "OOXML" if first.startswith(OOXML) else "ZIP"


def format_of(data: bytes) -> str:
    """The format of one file's bytes."""
    head = bytes(data[:16])
    for name, magic in HEADS:
        if head.startswith(magic):
            if name != "RIFF":
                return name
            if head[8:12] in RIFF_KINDS:
                return RIFF_KINDS[head[8:12]]
    if _mp3(head):
        return "audio"
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF"
    if raw.identify(data) is not None:
        return "camera raw"
    order = byte_order(head)
    if order and head[2:4] in (b"*\0", b"\0*") and int.from_bytes(head[2:4], order) == 42:
        return "TIFF"
    if (brand := _brand(data)) is not None:
        return brand
    if _starts_xml(data[:256]):
        near = data[:XMP_SCAN].lower()
        if b"xmpmeta" in near and b"<svg" not in near:
            return "XMP sidecar"
        if b"<svg" in near[:SVG_SCAN]:
            return "SVG"
    if head[:4] in (b"PK\3\4", b"PK\5\6"):
        return _zip(data)
    return UNKNOWN


def needs_probe(content: Column) -> Column:
    """Whether leading bytes alone do not decide: TIFF-like and ISO media files are walked in Python."""
    return F.substring(content, 1, 2).isin(b"II", b"MM") | (F.substring(content, 5, 4) == F.lit(b"ftyp"))


def detect_format(content: Column) -> Column:
    """The format as a Spark expression, evaluated in generated code; null where ``needs_probe``."""
    head = F.substring(content, 1, 16)

    def starts(magic: bytes) -> Column:
        return F.substring(content, 1, len(magic)) == F.lit(magic)

    rules: list[tuple[Column, Column]] = []
    for name, magic in HEADS:
        if name == "RIFF":
            rules += [(starts(magic) & (F.substring(content, 9, 4) == F.lit(k)), F.lit(v)) for k, v in RIFF_KINDS.items()]
        else:
            rules.append((starts(magic), F.lit(name)))
    second = F.conv(F.hex(F.substring(content, 2, 1)), 16, 10).cast("int")
    sync = starts(b"\xff") & (F.length(head) > 1) & (second.bitwiseAND(0xE0) == 0xE0) & (second.bitwiseAND(0x18) != 8) & (second.bitwiseAND(6) != 0)
    rules.append((starts(b"ID3") | F.coalesce(sync, F.lit(False)), F.lit("audio")))
    rules.append((starts(b"GIF87a") | starts(b"GIF89a"), F.lit("GIF")))
    rules.append((starts(b"FUJIFILMCCD-RAW") | starts(b"FOVb"), F.lit("camera raw")))
    rules.append((needs_probe(content), F.lit(None).cast("string")))
    text = F.lower(F.make_valid_utf8(F.substring(content, 1, XMP_SCAN).cast("string")))
    # one decode settles the files that are no markup; only markup is looked at again
    openers = "|".join(re.escape(o) for o in ("<?xml", "<svg", "<!--", "<!doctype svg", "<x:xmpmeta", "<?xpacket", "<rdf:rdf"))
    markup = text.rlike(rf"^\x{{FEFF}}?[\t\r\n\f ]*(?:{openers})")
    kind = F.when(F.contains(text, F.lit("xmpmeta")) & ~F.contains(text, F.lit("<svg")), "XMP sidecar").when(F.contains(F.substring(text, 1, SVG_SCAN), F.lit("<svg")), "SVG")
    rules.append((markup, kind.otherwise(UNKNOWN)))
    size = F.conv(F.hex(F.concat(F.substring(content, 28, 1), F.substring(content, 27, 1))), 16, 10).cast("int")
    first = F.make_valid_utf8(F.substring(content, F.lit(31), size).cast("string"))
    ooxml = reduce(lambda a, b: a | b, (first.startswith(p.decode()) for p in OOXML))
    kind = F.make_valid_utf8(F.substring(content, size + 31, F.lit(200)).cast("string"))
    flavour = F.when((first == "mimetype") & F.contains(kind, F.lit("opendocument")), "OpenDocument").when(ooxml, "OOXML").otherwise("ZIP")
    rules.append((starts(b"PK\x03\x04") | starts(b"PK\x05\x06"), flavour))
    out = F
    for test, value in rules:
        out = out.when(test, value)
    return F.when(content.isNull(), None).otherwise(out.otherwise(UNKNOWN))


@F.arrow_udf(returnType=StringType())
def _probe(content: pa.Array) -> pa.Array:
    return pa.array([None if (d := x.as_py()) is None else format_of(d) for x in content], pa.string())


def detect_files(files: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of each row with the ``format`` of its ``content``.

    Leading bytes decide in generated code; only the bytes of TIFF-like and ISO media files go to Python.
    """
    prepare(files.sparkSession)
    content = F.col("content")
    return files.select(*keep, F.coalesce(detect_format(content), _probe(F.when(needs_probe(content), content))).alias("format"))
