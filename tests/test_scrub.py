import json
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import samples as s  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tracewipe.functions import binary, text  # noqa: E402
from tracewipe.operators import markup_ops, pixels, report  # noqa: E402
from tracewipe.operators.detect import detect_format, format_of, needs_probe  # noqa: E402
from tracewipe.operators.scrub import inspect, scrub  # noqa: E402
from tracewipe.sources import export, files  # noqa: E402
from tracewipe.streaming import scrub_stream  # noqa: E402

ODD = {"none": None, "empty": b"", "text": b"plain words", "cut": s.png_full()[:40], "video": b"\x1a\x45\xdf\xa3abc"}


def frame(spark, files=None):
    rows = list((files or {**s.ALL, **ODD}).items())
    return spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b in rows], "file string, content binary")


def test_every_row_comes_back_with_a_report_or_an_error(spark):
    out = {r.file: r for r in scrub(frame(spark).withColumn("format", F.lit("own")), ["file"], verify=True).collect()}
    assert len(out) == len(s.ALL) + len(ODD)
    for name in s.ALL:
        assert out[name].format == name and out[name].verification.passed and out[name].error is None and out[name].data is not None
    assert out["none"].error["class"] == "io" and out["cut"].error["class"] == "malformed"
    for name in ("empty", "text", "video"):
        assert out[name].assurance == 2 and out[name].data is None and out[name].verification is None


def test_inspect_makes_no_output_column(spark):
    assert "data" not in inspect(frame(spark), ["file"]).columns


def test_detection_in_spark_agrees_with_single_files(spark):
    more = {**s.ALL, **ODD, "webm": b"\x1a\x45\xdf\xa3", "mp3": b"\xff\xfb\x90", "utf16": b"\xff\xfeab", "zip": s.zip_file([("a.txt", b"x")]), "bom": b"\xef\xbb\xbf<?xml?><svg/>", "avi": b"RIFF\0\0\0\0AVI ", "html": b"<!DOCTYPE html><svg>", "mp4": s.box(b"ftyp", b"isom\0\0\0\0mp42")}
    got = frame(spark, more).select("file", "content", detect_format(F.col("content")).alias("format"), needs_probe(F.col("content")).alias("probe")).collect()
    for r in got:
        if r.content is None:
            assert r.format is None
        elif r.probe:
            assert r.format is None and format_of(bytes(r.content)) in ("TIFF", "HEIF", "AVIF", "camera raw", "video", "audio")
        else:
            assert r.format == format_of(bytes(r.content)), r.file


def test_report_questions(spark):
    r = inspect(frame(spark), ["file"]).cache()
    kinds = {x.kind: x for x in report.by_kind(r).collect()}
    n = r.select(F.sum(F.size("removed"))).first()[0]
    assert sum(x.n for x in kinds.values()) == n and kinds["EXIF"].kind_ord == 0
    roll = report.by_format_and_kind(r).collect()
    assert next(x.n for x in roll if x.format is None and x.kind is None) == n
    w = report.worst(r).first()
    assert (w.assurance, w.found_location, w.exit_code) == (2, True, 2)
    assert r.select(F.max(report.exit_code())).filter("1 = 1").first()[0] == 2
    buckets = {x.format: x for x in report.assurance_buckets(r).collect()}
    assert buckets["PNG"].complete == 1 and buckets["PNG"].skipped == 1 and buckets["PDF"].partial == 1
    assert report.writable(r).count() == len(s.ALL)
    cover = {x.format: x.files for x in report.coverage(r).collect()}
    assert len(cover) == 17 and cover["ZIP"] == 0 and cover["PNG"] == 2
    png_json = json.loads(r.filter("file = 'PNG'").select(report.as_json(F.col("file"))).first()[0])
    assert png_json["file"] == "PNG" and png_json["removed"][0] == {"kind": "comment", "location": "tEXt", "bytes": 18}
    bridge = json.loads(r.filter("file = 'PDF'").select(report.as_json(F.col("file"), bridge=True)).first()[0])
    assert bridge["assurance"] == "best_effort" and "file" not in bridge
    lines = r.filter("file = 'JPEG'").select(report.as_text()).first()[0].split("\n")
    assert lines[0].startswith("JPEG | findings=") and " place=yes " in lines[0] and lines[1].startswith("gone\t")
    assert {x.summary for x in r.filter("file in ('text', 'none')").select(report.summary().alias("summary")).collect()} == {"unknown format | left as it was", "? | failed (no content)"}
    values = [f for x in r.collect() for f in [*(y.location for y in x.removed), *x.warnings]]
    assert not any("CANARY" in v for v in values)  # reports say where, never what
    r.unpersist()


def test_quiet_and_absorbed(spark):
    r = inspect(frame(spark, {"clean": s.png_file(), "full": s.png_full(), "jpeg": s.jpeg_full()}), ["file"])
    assert {x.file for x in report.loud(r).collect()} == {"full", "jpeg"}
    p = r.withColumn("parent_id", F.lit(1))
    out = report.absorbed(p.filter("file = 'clean'"), p.filter("file <> 'clean'")).first()
    assert out.found_location and out.n_removed > 10 and out.assurance == 0


def test_archive_members(spark):
    rows = files.members(frame(spark, {"docx": s.docx_full(), "bad": b"nothing", "none": None}), ["file"]).collect()
    docx = [r for r in rows if r.file == "docx"]
    assert len(docx) == 8 and all(len(r.data) == r.size for r in docx)
    assert {r.file: r.error for r in rows if r.member is None} == {"bad": "malformed", "none": "malformed"}


def test_scan_limit_is_pushed_and_sidecars_pair(spark, tmp_path):
    for name, size in (("a.jpg", 3), ("A.b.jpg", 2), ("a.xmp", 1), ("a.jpg.XMP", 1), ("b.xmp", 1), ("A.b.thm", 1), ("c.Xmp", 1), ("big.bin", 50)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = files.read_files(spark, str(tmp_path), limit=10)
    assert found.count() == 7 and files.oversized(spark, str(tmp_path), limit=10).count() == 1
    assert "LessThanOrEqual(length,10)" in found._jdf.queryExecution().toString()
    listing = found.select("path")
    pairs = files.sidecars(listing.filter("path rlike 'jpg$'"), listing).collect()
    assert {(r.path.rpartition("/")[2], r.sidecar.rpartition("/")[2]) for r in pairs} == {("a.jpg", "a.xmp"), ("a.jpg", "a.jpg.XMP"), ("A.b.jpg", "A.b.thm")}


def test_export_and_names(spark, tmp_path):
    cleaned = scrub(frame(spark, {"x.png": s.png_full(), "y.txt": b"text"}), ["file"])
    out = export.export(cleaned, F.concat(F.lit(f"{tmp_path}/"), export.clean_name(F.col("file")))).collect()
    assert [r.path for r in out] == [f"{tmp_path}/x.clean.png"] and (tmp_path / "x.clean.png").read_bytes() == s.png_file()
    assert [p.name for p in tmp_path.iterdir()] == ["x.clean.png"]
    names = spark.createDataFrame([("/d/a.JPG",), ("/d/noext",), ("/d/.hidden",)], "p string")
    r = names.select(export.clean_name(F.col("p")).alias("c"), export.random_name(F.col("p"), F.lit("s")).alias("r"), export.washed_name(F.col("p"), F.lit(True)).alias("w")).collect()
    assert [x.c for x in r] == ["/d/a.clean.JPG", "/d/noext.clean", "/d/.hidden.clean"] and r[0].r.endswith(".jpg") and len(r[0].r) == 3 + 24 + 4
    assert r[0].w == "/d/a.png" and len({x.r for x in r}) == 3


def test_markup_columns(spark):
    df = spark.createDataFrame([(1, s.SVG.decode()), (2, None), (3, "")], "id long, m string")
    out = {r.id: r for r in markup_ops.scrub_markup(df, "m", ["id"]).collect()}
    assert (out[1].comments, out[1].metadata, out[1].scripts, out[1].editor, out[1].external) == (1, 1, 1, 3, 4) and "CANARY" not in out[1].cleaned
    assert out[2].cleaned == "" and out[3].comments == 0


def test_binary_functions(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\xff\0\0"),)], "b binary")
    b = F.col("b")
    r = df.select(
        binary.big_endian(b, 0, 2).alias("be"), binary.little_endian(b, 0, 4).alias("le"), binary.big_endian(b, 5, 4).alias("none"), binary.all_zero(F.substring(b, 6, 2)).alias("zero"), F.crc32(F.lit(b"123456789")).alias("crc")
    ).first()
    assert (r.be, r.le, r.none, r.zero, r.crc) == (0x0102, 0x04030201, None, True, 0xCBF43926)
    assert df.select(binary.contains_ascii(F.lit(b"\xffAb\xffXMPmeta"), "xmpMETA")).first()[0]
    assert [x[0] for x in df.select(F.explode(F.array(text.matches_search("", b), text.matches_search("ZZ", F.lit("buzz"))))).collect()] == [True, True]


def test_row_filters_against_pixel_by_pixel():
    import numpy as np

    rng = np.random.default_rng(2)
    for h, w, n in ((1, 1, 1), (7, 5, 3), (3, 20, 4), (20, 3, 2), (12, 12, 1)):
        kinds, lines = rng.integers(0, 5, h).astype(np.uint8), rng.integers(0, 256, (h, w, n)).astype(np.uint8)
        want = np.zeros((h, w, n), int)
        for y in range(h):
            for x in range(w):
                for k in range(n):
                    left, above, corner = (int(want[y, x - 1, k]) if x else 0), (int(want[y - 1, x, k]) if y else 0), (int(want[y - 1, x - 1, k]) if x and y else 0)
                    p = left + above - corner
                    near = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                    want[y, x, k] = (int(lines[y, x, k]) + (0, left, above, (left + above) // 2, near)[kinds[y]]) & 255
        assert (pixels.unfiltered(kinds, lines) == want).all()


def test_pixels(spark):
    import numpy as np

    rgb = np.random.default_rng(1).integers(0, 255, (30, 40, 3), dtype=np.uint8)
    data = pixels.encode(rgb)
    assert (pixels.decode(data) == rgb).all()
    flat = np.full((9, 9), 7.0)
    assert np.allclose(pixels.box_blur(flat, 2), 7)
    line = np.array([[0.0, 0, 10, 0, 0]] * 3)
    k = np.pad(line[0], 1, mode="edge")
    once = np.array([k[i : i + 3].mean() for i in range(5)])
    k = np.pad(once, 1, mode="edge")
    assert np.allclose(pixels.box_blur(line, 1)[1], [k[i : i + 3].mean() for i in range(5)])
    out, r = pixels.wash(data, "strong")
    assert (r["new_w"], r["new_h"], r["quality"]) == (20, 15, None) and pixels.wash(data, "strong")[0] == out
    assert max(pixels.decode(pixels.to_png(data, max_edge=16)).shape[:2]) == 16
    small = pixels.to_png(data, max_bytes=len(data) // 2)
    assert len(small) <= len(data) // 2
    rows = {x.file: x for x in pixels.wash_files(frame(spark, {"ok": data, "jpeg": s.BARE_JPEG, "none": None, "bad": data[:60]}), ["file"]).collect()}
    assert rows["ok"].new_w == 28 and {k: v.error_class for k, v in rows.items()} == {"ok": None, "jpeg": "unsupported", "none": "io", "bad": "malformed"}


def test_row_filters_of_png_decode():
    import struct
    import zlib

    import numpy as np

    from tracewipe.operators.formats import png

    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 255, (5, 7, 3)).astype(np.int64)
    raw = b""
    for y, f in enumerate(range(5)):
        above = rgb[y - 1] if y else np.zeros((7, 3), int)
        line = []
        for x in range(7):
            left = rgb[y, x - 1] if x else np.zeros(3, int)
            corner = above[x - 1] if x else np.zeros(3, int)
            p = left + above[x] - corner
            paeth = [min(((abs(p[c] - v[c]), i) for i, v in enumerate((left, above[x], corner))))[1] for c in range(3)]
            guess = [0 * left, left, above[x], (left + above[x]) // 2, np.array([(left, above[x], corner)[i][c] for c, i in enumerate(paeth)])][f]
            line += ((rgb[y, x] - guess) & 255).tolist()
        raw += bytes([f, *line])
    data = png.MAGIC + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(raw)) + png.chunk(b"IEND", b"")
    assert (pixels.decode(data) == rgb).all()


def test_stream_scrubs_what_arrives(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.png").write_bytes(s.png_full())
    files_ = scrub_stream.once(scrub_stream.read_stream(spark, str(src)))
    policy = scrub_stream.Policy()
    q = scrub_stream.scrub_stream(files_, policy).writeStream.format("memory").queryName("scrubbed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("scrubbed").collect()
    assert len(rows) == 1 and bytes(rows[0].data) == s.png_file()
    assert scrub_stream.current(spark.table("scrubbed"), policy).count() == 1
    assert scrub_stream.current(spark.table("scrubbed"), scrub_stream.Policy(keep_profile=True)).count() == 0
