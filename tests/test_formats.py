import random
import struct
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import samples as s  # noqa: E402

from tracewipe.operators.detect import format_of  # noqa: E402
from tracewipe.operators.formats import archive, exif, jpeg, markup, pdf, png, raw, webp  # noqa: E402
from tracewipe.operators.model import BEST_EFFORT, COMPLETE, NONE, Policy, ScrubError  # noqa: E402
from tracewipe.operators.scrub import scrub_bytes, verified  # noqa: E402

COMPLETES = {"PNG", "JPEG", "GIF", "WebP", "TIFF", "XMP sidecar"}


@pytest.mark.parametrize("name", s.ALL)
def test_planted_data_goes_and_the_result_is_a_fixed_point(name):
    data = s.ALL[name]
    assert format_of(data) == name
    out, report = verified(data)
    assert report.format == name and report.removed and report.output_len == len(out)
    assert report.assurance == (COMPLETE if name in COMPLETES else BEST_EFFORT)
    if name not in ("OOXML", "OpenDocument"):
        assert s.CANARY not in out
    assert report.verification == (True, True)
    assert format_of(out) == name


@pytest.mark.parametrize("name", s.ALL)
def test_damage_is_an_error_or_a_result_but_never_a_crash(name):
    data, rng = s.ALL[name], random.Random(name)
    for _ in range(250):
        b = bytearray(data)
        for _ in range(rng.choice([1, 1, 2, 5])):
            b[rng.randrange(len(b))] = rng.randrange(256)
        if rng.random() < 0.3:
            del b[rng.randrange(len(b)) :]
        if rng.random() < 0.1:
            at = rng.randrange(len(b) + 1)
            b[at:at] = rng.randbytes(rng.randrange(40))
        try:
            scrub_bytes(bytes(b))
        except ScrubError:
            pass


def test_location_is_found_where_it_is():
    for name in ("PNG", "JPEG", "WebP", "HEIF", "TIFF", "OOXML", "XMP sidecar"):
        assert scrub_bytes(s.ALL[name])[1].found_location, name
    assert not scrub_bytes(s.png_file())[1].found_location


def test_clean_files_stay_byte_identical():
    for data in (s.png_file(), s.BARE_JPEG, s.gif_file(), s.webp_file(webp.chunk(b"VP8 ", b"1234"))):
        out, report = scrub_bytes(data)
        assert out == data and not report.removed


def test_png_rules():
    assert scrub_bytes(s.png_full())[0] == s.png_file()
    kept, report = scrub_bytes(s.png_full(), Policy(keep_profile=True))
    assert b"iCCP" in kept and "ICC_PROFILE" in report.retained
    kinds = [k for k, _, _ in scrub_bytes(s.png_full())[1].removed]
    assert kinds == ["comment", "XMP", "EXIF", "maker note", "timestamp", "unrecognised structure", "colour profile", "trailing data"]
    bad = bytearray(s.png_file())
    bad[-1] ^= 1
    with pytest.raises(ScrubError):
        scrub_bytes(bytes(bad))
    broken_text = bytearray(s.png_file(png.chunk(b"tEXt", b"a\0b")))
    broken_text[broken_text.index(b"tEXt") + 8] ^= 1  # the checksum of a dropped chunk does not matter
    assert scrub_bytes(bytes(broken_text))[0] == s.png_file()
    with pytest.raises(ScrubError):
        scrub_bytes(s.png_file()[:-12])


def test_jpeg_rules():
    out, report = scrub_bytes(s.jpeg_full())
    assert out == s.BARE_JPEG and "ORIENTATION_DROPPED" in report.warnings
    turned, _ = scrub_bytes(s.jpeg_full(), Policy(keep_orientation=True))
    assert exif.inspect(turned[turned.index(b"Exif\0\0") + 6 :]).orientation == 6 and s.CANARY not in turned
    cut, report = scrub_bytes(s.BARE_JPEG[:-2])
    assert cut == s.BARE_JPEG and "JPEG_TRUNCATED" in report.warnings
    video = s.BARE_JPEG + b"\0\0\0\x18ftypmp42"
    assert "JPEG_EMBEDDED_VIDEO" in scrub_bytes(video)[1].warnings
    jfif = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\2\3" + bytes(18)) + s.BARE_JPEG[2:]
    out, report = scrub_bytes(jfif)
    assert report.removed == [("thumbnail", "APP0 JFIF thumbnail", 18)] and out[4:20].startswith(b"\0\x10JFIF")
    adobe = b"\xff\xd8" + jpeg.segment(0xEE, b"Adobe\0\x65\1\2\3\4\1extra") + s.BARE_JPEG[2:]
    out, report = scrub_bytes(adobe)
    assert jpeg.segment(0xEE, b"Adobe\0\x64\0\0\0\0\1") in out and report.removed == [("unrecognised structure", "APP14 Adobe tail", 5)]


def test_gif_keeps_one_loop_in_canonical_form():
    out, report = scrub_bytes(s.gif_full())
    assert out == s.gif_file(s.LOOP + b"\x21\xf9\4\1\2\3\4\0")
    assert [k for k, _, _ in report.removed] == ["comment", "XMP", "unrecognised structure", "unrecognised structure", "trailing data"]
    assert "GIF_TRUNCATED" in scrub_bytes(s.gif_file()[:-1])[1].warnings


def test_webp_flags_and_frames():
    out, report = scrub_bytes(s.webp_full())
    assert out[20] == 0 and b"ANMF" in out and b"note" not in out
    assert ("unrecognised structure", "ANMF/note", len(s.CANARY)) in report.removed
    assert int.from_bytes(out[4:8], "little") == len(out) - 8
    kept, _ = scrub_bytes(s.webp_full(), Policy(keep_profile=True))
    assert kept[20] == 0x20 and b"ICCP" in kept
    with pytest.raises(ScrubError):
        scrub_bytes(s.webp_file(webp.chunk(b"XMP ", b"x")))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [273, 324])
def test_tiff_pixels_survive_directories_do_not(order, kind):
    out, report = scrub_bytes(s.tiff_full(order, kind))
    assert b"PIXL" in out and b"abc" in out and s.CANARY not in out
    labels = [w for _, w, _ in report.removed]
    assert "TIFF tag: image description" in labels and "reduced-resolution page" in labels and "1 non-structural tag(s)" in labels
    again, report = scrub_bytes(out)
    assert again == out and not report.removed
    turned, _ = scrub_bytes(s.tiff_full(order, kind), Policy(keep_orientation=True, keep_profile=True))
    assert s.CANARY in turned and len(turned) > len(out)


def test_tiff_that_looks_raw_is_left_alone():
    data = s.tiff([(256, 3, 1, b"\1\0"), (33421, 3, 2, b"\2\0\2\0")])
    out, report = scrub_bytes(data)
    assert out == data and report.assurance == NONE and report.warnings == ["TIFF_LOOKS_RAW"] and report.verification is None


def test_heif_tables_are_joined():
    out, report = scrub_bytes(s.heif_full())
    assert len(out) == len(s.heif_full())
    assert "HEIF_ITEM_NO_LOCATION" in report.warnings and "HEIF_ITEM_IN_ITEM" in report.warnings and "HEIF_OVERWRITTEN" in report.warnings
    assert [w for _, w, _ in report.removed if w.startswith("meta item")] == ["meta item 1", "meta item 2"]
    assert "ICC_PROFILE" in report.retained


def test_svg_keeps_the_picture():
    out, report = scrub_bytes(s.SVG)
    for kept in ("grüße &lt; 1".encode(), b"xlink:href='#ok'", b'fill="url(#g)"', b"<![CDATA[ <b> ]]>", b"fill:url(about:blank)", b"<!DOCTYPE svg>"):
        assert kept in out
    assert [w for _, w, _ in report.removed] == ["1 XML comment(s)", "metadata / RDF block", "1 script element(s)", "3 editor field(s)", "4 external reference(s)"]


@pytest.mark.parametrize(
    ("value", "outside"),
    [(b"http://a", True), (b" java\tscript:x", True), (b"&#106;avascript:x", True), (b"&#x68;ttp&#58;//a", True), (b"//host", True), (b"#id", False), (b"data:x", False), (b"img/http:/x", False), (b"", False), (b"mailto:x", False)],
)
def test_references(value, outside):
    assert markup.leaves_document(value) is outside


def test_xml_rules():
    data = b"<a AUTHOR='Bob > Co' initials=\"B\" w:rsidRPr='1' dateUtc=\"x\" xmlns:date=\"u\"><b name='n'/></a>"
    out, blanked, removed = markup.scrub_attributes(data)
    assert out == b"<a AUTHOR='author' initials=\"a\" xmlns:date=\"u\"><b name='n'/></a>" and (blanked, removed) == (2, 2)
    assert markup.scrub_attributes(out)[0] == out
    assert markup.scrub_attributes(b"<p name='n' displayName='x'/>", markup.NAME_RULES)[0] == b"<p name='author' displayName='author'/>"
    assert markup.remove_elements(b"<s><r><r/>x<r>y</r></r>z<r/></s>", frozenset((b"r",))) == (b"<s>z</s>", 2)
    assert markup.blank_text(b"<c><author>Bob</author><author/><x>Bob</x></c>", frozenset((b"author",))) == (b"<c><author>author</author><author/><x>Bob</x></c>", 1)


def test_office_parts():
    out, report = scrub_bytes(s.docx_full())
    parts = {m.path: m for m in archive.read(out)}
    assert all(s.CANARY not in m.read() for m in parts.values())
    assert b"Body &amp; text" in parts["word/document.xml"].read() and b"<w:zoom/>" in parts["word/settings.xml"].read()
    assert parts["word/media/image1.jpeg"].read() == s.BARE_JPEG
    assert any(w.startswith("word/media/image1.jpeg → APP1") for _, w, _ in report.removed)
    assert "DOC_OPAQUE_PART: vbaProject.bin" in report.warnings
    left, report = scrub_bytes(s.docx_full(), Policy(recurse=False))
    assert {m.path: m for m in archive.read(left)}["word/media/image1.jpeg"].read() == s.jpeg_full() and "DOC_EMBEDDED_SKIPPED" in report.warnings
    odt = {m.path: m for m in archive.read(scrub_bytes(s.odt_full())[0])}
    assert all(s.CANARY not in m.read() for m in odt.values()) and b"<p>text</p>" in odt["content.xml"].read()


def test_archives_are_refused_where_they_should_be():
    good = s.zip_file([("[Content_Types].xml", b"<T/>"), ("word/x.xml", b"<a/>" * 50)])
    locked = bytearray(good)
    locked[good.index(b"PK\1\2") + 8] |= 1
    with pytest.raises(ScrubError) as e:
        scrub_bytes(bytes(locked))
    assert e.value.cls == "encrypted"
    bad = bytearray(good)
    bad[good.rindex(b"PK\1\2") + 16] ^= 1  # its checksum
    with pytest.raises(ScrubError):
        scrub_bytes(bytes(bad))
    bomb = archive.Member(b"[Content_Types].xml", 0, 8, 0, 0, b"")
    bomb.write(bytes(archive.MOST_INFLATED + 1))
    with pytest.raises(ScrubError) as e:
        bomb.read()
    assert e.value.cls == "too_large"


def test_pdf_graph():
    for table in (True, False):
        out, report = scrub_bytes(s.pdf_full(table))
        assert s.CANARY not in out and b"BT (hi) Tj ET" in out and b"/ID" not in out and b"note" in out
        assert [k for k, _, _ in report.removed] == ["document info", "timestamp", "author identity", "document info", "XMP", "document info", "comment"]
    with pytest.raises(ScrubError) as e:
        scrub_bytes(s.pdf_full().replace(b"/Size 9", b"/Encrypt 4 0 R/Size 9"))
    assert e.value.cls == "encrypted"


def test_pdf_object_streams():
    head = b"1 0 2 30 "
    first = b"<</Type/Catalog/Pages 2 0 R>>".ljust(30) + b"<</Type/Pages/Kids[]/Count 0/Author(CANARY-7f3a)>>"
    packed = zlib.compress(head + first)
    body = b"%PDF-1.5\n"
    at = len(body)
    body += b"3 0 obj\n<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    x = len(body)
    rows = struct.pack(">BHB", 0, 0, 0) + struct.pack(">BHB", 2, 3, 0) + struct.pack(">BHB", 2, 3, 1) + struct.pack(">BHB", 1, at, 0) + struct.pack(">BHB", 1, x, 0)
    body += b"4 0 obj\n<</Type/XRef/Size 5/W[1 2 1]/Root 1 0 R/Length %d>>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (len(rows), rows, x)
    out, report = scrub_bytes(body)
    assert s.CANARY not in out and b"/Pages" in out and b"ObjStm" not in out
    assert pdf.Document(out).objects.keys() == {1, 2}


def _lzw_encoded(data):
    """Codes of 9 bits with a clear before each 200: the plainest valid encoding."""
    bits = ""
    for i in range(0, len(data), 200):
        bits += f"{256:09b}" + "".join(f"{b:09b}" for b in data[i : i + 200])
    bits += f"{257:09b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_pdf_filters_and_predictors(monkeypatch):
    import base64

    data = bytes(range(256)) * 3 + b"abcabcabc" * 50
    runs = b"".join(bytes((min(127, len(data) - i - 1),)) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x81x" + b"\x80"
    forms = {b"FlateDecode": zlib.compress(data), b"ASCIIHexDecode": data.hex().encode() + b">", b"ASCII85Decode": base64.a85encode(data) + b"~>", b"LZWDecode": _lzw_encoded(data)}
    for name, packed in forms.items():
        assert pdf.inflated(pdf.Stream({b"Filter": pdf.Name(name)}, packed)) == data, name
    assert pdf.inflated(pdf.Stream({b"Filter": pdf.Name(b"RunLengthDecode")}, runs)) == data + b"x" * 128
    chain = [pdf.Name(b"ASCIIHexDecode"), pdf.Name(b"FlateDecode")]
    width, step = 12, 3
    plain = [bytes((i * 7 + j * j) & 255 for j in range(width)) for i in range(10)]
    coded, prior = b"", bytes(width)
    for i, row in enumerate(plain):
        rule = i % 5
        coded += bytes((rule,))
        for x in range(width):
            a, b, c = (row[x - step], prior[x], prior[x - step]) if x >= step else (0, prior[x], 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded += bytes(((row[x] - (0, a, b, (a + b) // 2, paeth)[rule]) & 255,))
        prior = row
    parms = {b"Predictor": b"15", b"Colors": b"3", b"Columns": b"4"}
    packed = zlib.compress(coded).hex().encode() + b">"
    assert pdf.inflated(pdf.Stream({b"Filter": chain, b"DecodeParms": [None, parms]}, packed)) == b"".join(plain)
    monkeypatch.setattr(pdf, "MOST_INFLATED", 1000)
    for name in (b"FlateDecode", b"LZWDecode"):
        with pytest.raises(ScrubError) as e:
            pdf.inflated(pdf.Stream({b"Filter": pdf.Name(name)}, forms[name]))
        assert e.value.cls == "too_large"


def test_raw_is_cleaned_in_place():
    data = s.raw_full()
    out, report = scrub_bytes(data)
    assert len(out) == len(data) and b"NIKON" in out and b"SENS" in out and b"makernot" in out
    assert ("EXIF", "TAGS x1", 12) in report.removed and ("author identity", "TAGS x1", 4) in report.removed
    assert "MAKER_NOTE" in report.retained and [w for _, w, _ in report.removed if "PREVIEW" in w] == ["PREVIEW#xmp", "PREVIEW#comment"]


def test_protected_ranges_win():
    zero = [(0, 5, "a"), (10, 20, "b"), (20, 22, "c"), (30, 40, "d")]
    assert raw.unprotected(zero, [(5, 10), (15, 16), (39, 50)]) == [(0, 5, "a"), (20, 22, "c")]
    assert raw.unprotected(zero, []) == zero


def test_raws_are_told_apart():
    cases = {
        b"FUJIFILMCCD-RAW 0201": "Fujifilm RAF", b"FOVb" + bytes(20): "Sigma X3F", s.box(b"ftyp", b"crx \0\0\0\1crx "): "Canon CR3", b"II\x55\0" + bytes(20): "Panasonic RW2",
        b"IIRO" + bytes(20): "Olympus ORF", b"II*\0\x10\0\0\0CR\2\0": "Canon CR2", b"MM\0*\0\0\0\x10IIII": "Phase One IIQ",
    }
    for data, name in cases.items():
        assert raw.identify(data)[0] == name
    assert raw.identify(s.tiff_full()) is None
    assert scrub_bytes(b"FOVb" + bytes(20))[1].assurance == NONE


def test_what_cannot_be_cleaned_says_so():
    for data, kind, warning in ((b"OggS", "audio", "AUDIO_NOT_CLEANED"), (b"\x1a\x45\xdf\xa3", "video", "VIDEO_NOT_CLEANED"), (b"hello", "unknown format", "FORMAT_NOT_CLEANED"), (b"PK\5\6" + bytes(18), "ZIP", "FORMAT_NOT_CLEANED")):
        out, report = scrub_bytes(data)
        assert (out, report.format, report.assurance, report.warnings) == (data, kind, NONE, [warning])


def test_deep_nesting_ends():
    deep = s.docx_full()
    out, report = scrub_bytes(deep, depth=8)
    assert out == deep and report.warnings == ["NESTED_TOO_DEEP"]
    with pytest.raises(ScrubError) as e:
        scrub_bytes(b"x" * 11, Policy(max_bytes=10))
    assert e.value.cls == "too_large"


def test_exif_inspection():
    for order in (">", "<"):
        f = exif.inspect(s.exif_block(order))
        assert (f.gps, f.maker_note, f.thumbnail, f.orientation) == (True, True, False, 6)
    assert exif.inspect(b"") == exif.Findings() and exif.inspect(b"MM\0*\0\0\0\x08\0\0\0\0\0\x08").thumbnail
    assert exif.inspect(exif.orientation_block(99)[6:]).orientation == 1
