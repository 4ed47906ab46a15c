import random
import struct

import pytest
from pyspark.sql import functions as F

from tracewipe.operators import segments as sg
from tracewipe.operators.formats import jpeg, png, webp
from tracewipe.operators.model import Policy
from tracewipe.operators.scrub import scrub

IHDR = png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
END = png.chunk(b"IEND", b"")


def tiff(order="<", depth=1, maker=True, gps=True, thumbnail=True):
    """An EXIF block: a chain of directories by the pointer tag, the last with a place and a maker note."""
    head = b"II*\0" if order == "<" else b"MM\0*"
    out, at = head + struct.pack(order + "I", 8), 8
    for k in range(depth):
        entry = struct.pack(order + "HHII", 0x8769, 4, 1, at + 18)
        out += struct.pack(order + "H", 1) + entry + struct.pack(order + "I", 7 if thumbnail and k == 0 else 0)
        at += 18
    tags = [(0x927C, 7, 9)] * maker + [(2, 5, 3)] * gps + [(0x8825, 4, 1)]
    return out + struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHII", t, k, c, 8) for t, k, c in tags) + b"\0\0\0\0"


def pngs():
    r = random.Random(1)
    body = [png.chunk(b"tEXt", b"Author\0x"), png.chunk(b"iCCP", b"prof"), png.chunk(b"eXIf", tiff()), png.chunk(b"eXIf", tiff(">", 3, False)), png.chunk(b"eXIf", tiff(depth=7)), png.chunk(b"eXIf", b"II*"), png.chunk(b"t\xff\0T", b"q"), png.chunk(b"tRNS", b""), png.chunk(b"IDAT", bytes(100))]
    out = [png.MAGIC + IHDR + b"".join(r.choice(body) for _ in range(r.choice([0, 1, 3, 300]))) + END + r.choice([b"", b"tail"]) for _ in range(40)]
    out += [png.MAGIC, png.MAGIC + IHDR, png.MAGIC + END[:-1], b"\x88PNG", b"", png.MAGIC + b"\xff\xff\xff\xffABCD", png.MAGIC + IHDR[:-1] + b"x" + END, png.MAGIC + b"\0\0"]
    return out + [mutated(r, r.choice(out[:40])) for _ in range(60)]


def webps():
    r = random.Random(2)
    frame = bytes(16) + webp.chunk(b"VP8 ", b"abc") + webp.chunk(b"XXXX", b"hidden")
    body = [webp.chunk(b"VP8X", b"\xff" + bytes(9)), webp.chunk(b"VP8X", b"\x2c" + bytes(12)), webp.chunk(b"VP8X", b""), webp.chunk(b"ANMF", frame), webp.chunk(b"ANMF", frame + b"tail"), webp.chunk(b"ANMF", frame + webp.chunk(b"ALPH", b"z")[:-1]), webp.chunk(b"ANMF", b"short"),
            webp.chunk(b"EXIF", tiff()), webp.chunk(b"EXIF", tiff(thumbnail=False)), webp.chunk(b"XMP ", b"<x/>"), webp.chunk(b"ICCP", b"prof"), webp.chunk(b"what", b"odd"), webp.chunk(b"VP8 ", b"pic"), webp.chunk(b"VP8L", b"pict")]

    def riff(parts, tail=b""):
        return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WEBP" + parts + tail

    out = [riff(b"".join(r.choice(body) for _ in range(r.choice([1, 2, 5, 90]))), r.choice([b"", b"tail"])) for _ in range(40)]
    out += [b"RIFF", b"", riff(b""), riff(webp.chunk(b"XMP ", b"x")), riff(b"VP8 \xff\0\0\0ab"), b"RIFF\4\0\0\0WAVE", riff(b"VP")]
    return out + [mutated(r, r.choice(out[:40])) for _ in range(60)]


def mutated(r, data):
    out = bytearray(data)
    for _ in range(r.choice([1, 3])):
        out[r.randrange(8, len(out))] = r.randrange(256)
    return bytes(out[: r.choice([len(out), len(out), r.randrange(9, len(out))])])


@pytest.mark.parametrize(("format", "made"), [("PNG", pngs), ("WebP", webps)])
@pytest.mark.parametrize("policy", [Policy(), Policy(keep_profile=True)])
def test_as_the_grammar(spark, format, made, policy):
    magic = {"PNG": b"\x89PNG\r\n\x1a\n", "WebP": b"RIFF"}[format]
    data = [d for d in made() if d[:8].startswith(magic)]
    data = data if format == "PNG" else [d for d in data if d[8:12] == b"WEBP"]
    files = spark.createDataFrame(list(enumerate(data)), "id int, content binary").repartition(4)
    columns = ["id", "assurance", "found_location", "input_len", "output_len", "removed", "retained", F.col("error.class").alias("error"), "data"]
    want = {r.id: r for r in scrub(files, ["id"], policy).select(*columns).collect()}
    got = {r.id: r for r in sg.scrub_native(files, ["id"], format, policy).select(*columns).collect()}
    for i in want:
        assert got[i] == want[i], (i, data[i][:200])
    assert {w.error for w in want.values()} == {None, "malformed"} and any(w.found_location for w in want.values())


def test_errors_and_nulls(spark):
    files = spark.createDataFrame([(1, None), (2, b""), (3, b"GIF89a"), (4, png.MAGIC + IHDR + END)], "id int, content binary")
    rows = {r.id: r for r in sg.scrub_native(files, ["id"], "PNG").collect()}
    assert [rows[i].error and rows[i].error["class"] for i in (1, 2, 3, 4)] == ["io", "malformed", "malformed", None]
    assert rows[4].data == png.MAGIC + IHDR + END and sg.segment_table(files, ["id"], "PNG").select("id").distinct().count() == 1
    assert {r.error["class"] for r in sg.scrub_native(files.limit(3), ["id"], "WebP").collect()} == {"io", "malformed"}


def test_no_python_in_the_plan(spark):
    files = spark.createDataFrame([(1, png.MAGIC + IHDR + END)], "id int, content binary")
    for df in (sg.scrub_native(files, ["id"], "PNG"), sg.scrub_native(files, ["id"], "WebP"), sg.dropped(sg.segment_table(files, ["id"], "PNG"), "PNG")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "Python" not in plan and "InPandas" not in plan


def test_tables_of_segments(spark):
    head = b"\xff\xd8" + jpeg.segment(0xE1, b"Exif\0\0abc") + b"\xff" + jpeg.segment(0xFE, b"note") + jpeg.segment(0xDB, bytes(65)) + jpeg.segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\0\x34\xff\xd9"
    boxes = struct.pack(">I", 12) + b"ftypheic" + struct.pack(">I4sQ", 1, b"mdat", 20) + b"wxyz" + struct.pack(">I", 0) + b"free123"
    png_ = png.MAGIC + IHDR + png.chunk(b"tEXt", b"ab") * 2000 + END
    files = spark.createDataFrame([("j", head), ("b", boxes), ("p", png_)], "id string, content binary")
    rows = lambda f, i: [(r.ord, r.type, r.start, r.length) for r in sg.segment_table(files.filter(F.col("id") == i), ["id"], f).orderBy("ord").collect()]
    assert rows("JPEG", "j") == [(0, "FFD8", 0, 0), (1, "FFE1", 2, 9), (2, "FILL", 15, 0), (3, "FFFE", 16, 4), (4, "FFDB", 24, 65), (5, "FFDA", 93, 6)]
    assert rows("ISO media", "b") == [(0, "ftyp", 0, 4), (1, "mdat", 12, 4), (2, "free", 32, 3)]
    assert len(rows("PNG", "p")) == 2002 and rows("PNG", "p")[1999] == (1999, "tEXt", 8 + 25 + 14 * 1998, 2)
    gone = sg.dropped(sg.segment_table(files, ["id"], "PNG"), "PNG").groupBy("id", "kind").count().collect()
    assert [tuple(r) for r in gone] == [("p", "comment", 2000)]
    assert sg.kept(sg.segment_table(files, ["id"], "JPEG"), "JPEG").count() == 2


def test_walk_past_many_segments_is_linear(spark):
    many = png.MAGIC + IHDR + png.chunk(b"IDAT", b"") * 20_000 + END
    files = spark.createDataFrame([(1, many)], "id int, content binary")
    assert sg.segment_table(files, ["id"], "PNG").count() == 20_002
