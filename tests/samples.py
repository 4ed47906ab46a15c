"""Small files of every format, built here, with planted data whose removal is known."""

from __future__ import annotations

import struct
import zlib

from tracewipe.operators.formats import archive, gif, jpeg, png, webp  # noqa: F401

CANARY = b"CANARY-7f3a"


def tiff(tags, order="<", after=b"", extra_pages=()):
    """A TIFF of (tag, type, count, bytes) entries; longer values follow the directory."""
    start, out = 8, b""
    pages = [tags, *extra_pages]
    for k, page in enumerate(pages):
        n = len(page)
        at, rows, body = start + 2 + 12 * n + 4, b"", b""
        for t, kind, count, v in sorted(page, key=lambda e: e[0]):
            if len(v) > 4:
                rows += struct.pack(order + "HHII", t, kind, count, at + len(body))
                body += v + b"\0" * (len(v) & 1)
            else:
                rows += struct.pack(order + "HHI", t, kind, count) + v.ljust(4, b"\0")
        nxt = 0 if k == len(pages) - 1 else at + len(body)
        part = struct.pack(order + "H", n) + rows + struct.pack(order + "I", nxt) + body
        out += part
        start += len(part)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + out + after


def exif_block(order=">"):
    """Orientation 6, a GPS directory and an Exif directory with a maker note."""
    p = struct.Struct(order + "HHI4s")
    u = lambda v: struct.pack(order + "I", v)
    ifd0, gps = 8, 8 + 2 + 36 + 4
    sub = gps + 2 + 24 + 4
    note = sub + 2 + 12 + 4
    out = (b"MM" if order == ">" else b"II") + struct.pack(order + "HI", 42, ifd0)
    out += struct.pack(order + "H", 3) + p.pack(0x0112, 3, 1, struct.pack(order + "HH", 6, 0)) + p.pack(0x8769, 4, 1, u(sub)) + p.pack(0x8825, 4, 1, u(gps)) + u(0)
    out += struct.pack(order + "H", 2) + p.pack(1, 2, 2, b"N\0\0\0") + p.pack(2, 5, 3, u(note)) + u(0)
    out += struct.pack(order + "H", 1) + p.pack(0x927C, 7, len(CANARY) + 20, u(note)) + u(0)
    return out + CANARY + bytes(20)


def png_file(extra=b"", trailer=b""):
    return png.MAGIC + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + extra + png.chunk(b"IDAT", zlib.compress(b"\0\0")) + png.chunk(b"IEND", b"") + trailer


def png_full():
    extra = png.chunk(b"tEXt", b"Author\0" + CANARY) + png.chunk(b"iTXt", CANARY) + png.chunk(b"eXIf", exif_block()) + png.chunk(b"tIME", bytes(7)) + png.chunk(b"prVt", CANARY) + png.chunk(b"iCCP", b"p\0\0" + CANARY)
    return png_file(extra, CANARY)


SCAN = b"\x12\xff\0\x34\xff\xd0\x56"
BARE_JPEG = b"\xff\xd8" + jpeg.segment(0xDB, bytes(65)) + jpeg.segment(0xC0, bytes(11)) + jpeg.segment(0xC4, bytes(20)) + jpeg.segment(0xDA, b"\1\1\0\0\x3f\0") + SCAN + b"\xff\xd9"


def jpeg_full():
    extra = [
        jpeg.segment(0xE1, b"Exif\0\0" + exif_block()), jpeg.segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + CANARY), jpeg.segment(0xED, b"Photoshop 3.0\0" + CANARY),
        jpeg.segment(0xFE, CANARY), jpeg.segment(0xE7, CANARY), jpeg.segment(0xE2, b"ICC_PROFILE\0" + CANARY),
    ]
    return b"\xff\xd8" + b"".join(extra) + BARE_JPEG[2:] + CANARY


def gif_file(extra=b"", tail=b""):
    return b"GIF89a\1\0\1\0\0\0\0" + extra + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x4c\1\0\x3b" + tail


LOOP = b"\x21\xff\x0bNETSCAPE2.0\3\1\5\0\0"


def gif_full():
    comment = b"\x21\xfe" + bytes((len(CANARY),)) + CANARY + b"\0"
    xmp = b"\x21\xff\x0bXMP DataXMP" + bytes((len(CANARY),)) + CANARY + b"\0"
    return gif_file(LOOP + comment + xmp + LOOP + b"\x21\xf9\4\1\2\3\4\0" + b"\x21\x01" + b"\2ab\0", CANARY)


def webp_file(*chunks, tail=b""):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body + tail


def webp_full():
    frame = webp.chunk(b"ANMF", bytes(16) + webp.chunk(b"VP8 ", b"12345") + webp.chunk(b"note", CANARY))
    return webp_file(webp.chunk(b"VP8X", b"\x2c" + bytes(9)), webp.chunk(b"ICCP", CANARY), webp.chunk(b"VP8 ", b"123"), frame, webp.chunk(b"EXIF", exif_block()), webp.chunk(b"XMP ", CANARY), webp.chunk(b"junk", CANARY), tail=CANARY)


def tiff_full(order="<", kind=273):
    u = lambda *v: struct.pack(order + f"{len(v)}I", *v)
    s = lambda v: struct.pack(order + "H", v)
    page = [(256, 3, 1, s(2)), (257, 3, 1, s(2)), (259, 3, 1, s(1)), (274, 3, 1, s(6)), (270, 2, len(CANARY) + 1, CANARY + b"\0"), (306, 2, 20, b"2020:01:01 00:00:00\0"), (34853, 4, 1, u(8)), (34675, 7, len(CANARY), CANARY), (60000, 3, 1, s(1)), (282, 5, 1, u(72, 1))]
    page += [(kind, 4, 2, u(0, 0)), ({273: 279, 324: 325}[kind], 4, 2, u(4, 3))]
    small = [(254, 4, 1, u(1)), (kind, 4, 1, u(0)), ({273: 279, 324: 325}[kind], 4, 1, u(4))]
    n = len(tiff(page, order, extra_pages=[small]))
    page = [e if e[0] != kind else (kind, 4, 2, u(n, n + 4)) for e in page]
    small = [e if e[0] != kind else (kind, 4, 1, u(n)) for e in small]
    return tiff(page, order, b"PIXLabc", [small])


def box(tag, body):
    return struct.pack(">I", 8 + len(body)) + tag + body


def heif_full(brand=b"heic"):
    exif = b"\0\0\0\0" + exif_block()
    xmp = (b"<x:xmpmeta>" + CANARY).ljust(200)
    ftyp = box(b"ftyp", brand + b"\0\0\0\0mif1" + brand)
    infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + b"Exif\0") + box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 2, 0) + b"mime\0application/rdf+xml\0")
    infe += box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 3, 0) + b"Exif\0") + box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 9, 0) + b"Exif\0")
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 4) + infe)
    iprp = box(b"iprp", box(b"ipco", box(b"colr", b"prof" + bytes(8))))
    idat = box(b"idat", xmp)

    def iloc(exif_at):
        rows = struct.pack(">HHHHII", 1, 0, 0, 1, exif_at, len(exif)) + struct.pack(">HHHHII", 2, 1, 0, 1, 0, len(xmp)) + struct.pack(">HHHHII", 3, 2, 0, 1, 0, 4)
        return box(b"iloc", b"\1\0\0\0\x44\0" + struct.pack(">H", 3) + rows)

    size = len(ftyp) + 12 + len(iinf) + len(iloc(0)) + len(iprp) + len(idat)
    meta = box(b"meta", b"\0\0\0\0" + iinf + iloc(size + 8) + iprp + idat)
    return ftyp + meta + box(b"mdat", exif) + box(b"uuid", bytes.fromhex("be7acfcb97a942e89c71999491e3afac") + CANARY)


SVG = b"""<?xml version="1.0"?><!DOCTYPE svg><svg xmlns="http://www.w3.org/2000/svg" inkscape:version="1"><!-- CANARY-7f3a --><metadata><rdf:RDF>CANARY-7f3a</rdf:RDF></metadata>
<script>CANARY-7f3a</script><sodipodi:namedview a="CANARY-7f3a"/><a href="https://x/CANARY-7f3a" onclick="q()" xlink:href='#ok'><path d="M0 0" style="fill:url(http://CANARY-7f3a)" fill="url(#g)"/></a>
<style>@import "http://CANARY-7f3a"; p{fill:url( '//CANARY-7f3a' )}</style><text>gr\xc3\xbc\xc3\x9fe &lt; 1</text><![CDATA[ <b> ]]></svg>"""
XMP = b'<?xpacket begin="" id="x"?><x:xmpmeta><dc:creator>CANARY-7f3a</dc:creator><EXIF:gpslatitude>1</EXIF:gpslatitude></x:xmpmeta>'


def zip_file(parts, method=8):
    out = []
    for name, body in parts:
        m = archive.Member(name.encode(), 0, method, 0, 0, b"")
        m.write(body)
        out.append(m)
    return archive.write(out)


def docx_full():
    return zip_file([
        ("[Content_Types].xml", b"<Types/>"), ("docProps/core.xml", b"<cp:coreProperties><dc:creator>CANARY-7f3a</dc:creator></cp:coreProperties>"),
        ("docProps/app.xml", b"<Properties><Company>CANARY-7f3a</Company></Properties>"),
        ("other/renamed.xml", b'<?xml version="1.0"?><!-- x --><p:coreProperties xmlns:p="http://schemas.openxmlformats.org/package/2006/metadata/core-properties">CANARY-7f3a</p:coreProperties>'),
        ("word/document.xml", b'<w:document><w:ins w:author="CANARY-7f3a" w:date="2020-01-01T00:00:00Z" w:rsidR="00AA11BB"><w:t>Body &amp; text</w:t></w:ins></w:document>'),
        ("word/settings.xml", b"<w:settings><w:rsids><w:rsidRoot w:val='CANARY-7f3a'/></w:rsids><w:zoom/></w:settings>"), ("word/media/image1.jpeg", jpeg_full()), ("word/vbaProject.bin", b"macro"),
    ])


def odt_full():
    parts = [("mimetype", b"application/vnd.oasis.opendocument.text"), ("content.xml", b"<o><dc:creator>CANARY-7f3a</dc:creator><p>text</p></o>"), ("meta.xml", b"<office:document-meta>CANARY-7f3a</office:document-meta>")]
    return zip_file(parts, 0)


PDF_BODY = [
    b"<</Type/Catalog/Pages 2 0 R/Metadata 5 0 R/PieceInfo<</A(CANARY-7f3a)>>>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Annots[6 0 R]/Contents 7 0 R>>",
    b"<</Author(CANARY-7f3a \\) x)/Title(CANARY-7f3a)/CreationDate(D:2020)>>", b"<</Type/Metadata/Subtype/XML/Length 11>>\nstream\nCANARY-7f3a\nendstream", b"<</Type/Annot/T(CANARY-7f3a)/Contents(note)>>",
    b"<</Length 8 0 R>>\nstream\nBT (hi) Tj ET\nendstream", b"13",
]


def pdf_full(table=True, body=PDF_BODY):
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(body):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, o)
    at = len(out)
    if table:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(body) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer\n<</Size 9/Root 1 0 R/Info 4 0 R/ID[<aa><bb>]>>\n" + (b"startxref\n%d\n%%%%EOF\n" % at if table else b"")


def raw_full(make=b"NIKON CORPORATION\0"):
    u = lambda *v: struct.pack(f"<{len(v)}I", *v)
    preview = b"\xff\xd8" + jpeg.segment(0xE1, b"http://x" + CANARY) + jpeg.segment(0xFE, CANARY) + BARE_JPEG[2:]
    page = [(0x010F, 2, len(make), make), (0x0131, 2, len(CANARY) + 1, CANARY + b"\0"), (0x013B, 2, 4, b"abc\0"), (0x927C, 7, 8, b"makernot"), (0x0201, 4, 1, u(0)), (0x0202, 4, 1, u(len(preview))), (0x0111, 4, 1, u(0)), (0x0117, 4, 1, u(4))]
    n = len(tiff(page))
    page = [(t, k, c, u(n) if t == 0x0111 else u(n + 4) if t == 0x0201 else v) for t, k, c, v in page]
    return tiff(page, after=b"SENS" + preview)


ALL = {
    "PNG": png_full(), "JPEG": jpeg_full(), "GIF": gif_full(), "WebP": webp_full(), "TIFF": tiff_full(), "HEIF": heif_full(), "AVIF": heif_full(b"avif"), "SVG": SVG, "XMP sidecar": XMP,
    "OOXML": docx_full(), "OpenDocument": odt_full(), "PDF": pdf_full(), "camera raw": raw_full(),
}
