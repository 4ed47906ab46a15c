"""Every registered query of the engine with its DuckDB counterpart.

Containers are built around the rows of the driver's tables by ``build``, so DuckDB can say what must be
found without parsing anything. Every query reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary, text
from ..operators import handbook, intervals, markup_ops, pixels, report
from ..operators.detect import detect_files, detect_format, needs_probe
from ..operators.formats.xmp import MARKERS
from ..operators.model import Policy
from ..operators.scrub import inspect, scrub
from ..sources import export, files
from ..streaming.scrub_stream import current, generation, once, run_available, scrub_stream
from . import build, structures  # noqa: F401  (registers its queries)
from .registry import ORACLES, QUERIES  # noqa: F401
from .registry import docs as _docs
from .registry import expected as _expected
from .registry import query as _query
from .registry import table as _table

def _facts(files: DataFrame, *keep: str, policy: Policy = Policy()) -> DataFrame:
    """doc_id and what the report says, flat."""
    r = inspect(files, ["doc_id", *keep], policy)
    kinds = F.array_join(F.transform("removed", lambda x: x["kind"]), ",")
    return r.select("doc_id", *keep, "format", report.assurance_label().alias("assurance"), F.size("removed").cast("long").alias("n_removed"), kinds.alias("kinds"), report.bytes_removed().alias("bytes_removed"), "output_len")


_LEN = "strlen(coalesce(text, ''))"

# --- detection -----------------------------------------------------------------------------------


def _formats(df: DataFrame, column: str) -> DataFrame:
    content = F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")
    return df.select(detect_format(content).alias("format"), needs_probe(content).alias("probe")).groupBy("format", "probe").agg(F.count("*").alias("files"))


def _formats_sql(table: str, column: str) -> str:
    return f"""
SELECT CASE WHEN probe THEN NULL WHEN {column} IS NOT NULL AND starts_with({column}, 'RIFF') THEN NULL ELSE 'unknown format' END AS format, probe, count(*) AS files
FROM (SELECT {column}, coalesce({column}[1:2] IN ('II', 'MM') OR {column}[5:8] = 'ftyp', false) AS probe FROM {table}) GROUP BY ALL"""


@_query(_formats_sql("pages", "html"))
def detect_pages(spark, sf_dir):
    return _formats(_table(spark, sf_dir, "pages"), "html")


@_query(_formats_sql("documents", "text"))
def detect_documents(spark, sf_dir):
    return _formats(_table(spark, sf_dir, "documents"), "text")


@_query(_formats_sql("conversations", "text"))
def detect_conversations(spark, sf_dir):
    return _formats(_table(spark, sf_dir, "conversations"), "text")


_MAGIC = (
    (b"\xff\xd8\xff\xe0", "JPEG"), (b"\x89PNG\r\n\x1a\n", "PNG"), (b"RIFF\0\0\0\0WEBP", "WebP"), (b"RIFF\0\0\0\0AVI ", "video"), (b"RIFF\0\0\0\0WAVE", "audio"), (b"%PDF-1.7", "PDF"),
    (b"\x1a\x45\xdf\xa3", "video"), (b"OggS", "audio"), (b"fLaC", "audio"), (b"ID3\4", "audio"), (b"\xff\xfb\x90", "audio"), (b"GIF87a", "GIF"), (b"GIF89a", "GIF"),
    (b"FUJIFILMCCD-RAW ", "camera raw"), (b"FOVb", "camera raw"), (b"<?xpacket begin=''?><x:xmpmeta>", "XMP sidecar"), (b"<svg xmlns='s'>", "SVG"),
    (b"<?xml version='1.0'?><svg>", "SVG"), (b"PK\3\4" + bytes(22) + b"\x13\0\0\0[Content_Types].xml", "OOXML"), (b"PK\5\6", "ZIP"), (b"\0\0", "unknown format"),
)


@_query("SELECT doc_id, CASE doc_id % " + str(len(_MAGIC)) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, (_, n) in enumerate(_MAGIC)) + " END AS format FROM documents")
def detect_synthetic_magic(spark, sf_dir):
    head = F.element_at(F.array(*[build.lit(m) for m, _ in _MAGIC]), (F.pmod("doc_id", F.lit(len(_MAGIC))) + 1).cast("int"))
    return _docs(spark, sf_dir, F.concat(head, F.lit(b" "), build.text_bytes())).select("doc_id", detect_format(F.col("content")).alias("format"))


@_query("SELECT doc_id, strlen(text) > 4000 AS too_large FROM documents")
def size_gate(spark, sf_dir):
    r = inspect(_docs(spark, sf_dir, build.text_bytes()), ["doc_id"], Policy(max_bytes=4000))
    return r.select("doc_id", F.coalesce(F.col("error.class") == "too_large", F.lit(False)).alias("too_large"))


# --- markup --------------------------------------------------------------------------------------

_STRIPPED = r"regexp_replace(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g'), '<script[^>]*>(.|\n)*?</script>', '', 'g')"


@_query(r"""
SELECT reason, CAST(n AS BIGINT) AS n FROM (
  SELECT 'comments' AS reason, sum(len(regexp_extract_all(html, '<!--'))) AS n FROM pages UNION ALL
  SELECT 'scripts', sum(len(regexp_extract_all(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g'), '<script'))) FROM pages UNION ALL
  SELECT 'metadata', 0 UNION ALL SELECT 'editor', 0 UNION ALL SELECT 'external', 0)""")
def svg_findings_pages(spark, sf_dir):
    n = markup_ops.scrub_markup(_table(spark, sf_dir, "pages"), "html", ["page_id"], emit=False)
    total = n.agg(*[F.sum(r).alias(r) for r in markup_ops.svg.REASONS])
    return total.unpivot([], list(markup_ops.svg.REASONS), "reason", "n")


@_query(f"SELECT page_id, md5({_STRIPPED}) AS cleaned FROM pages")
def svg_scrub_pages(spark, sf_dir):
    return markup_ops.scrub_markup(_table(spark, sf_dir, "pages"), "html", ["page_id"]).select("page_id", F.md5("cleaned").alias("cleaned"))


@_query(r"SELECT page_id, md5(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g')) AS cleaned FROM pages")
def svg_comment_strip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_comments(F.col("html"))).alias("cleaned"))


@_query(r"SELECT page_id, md5(regexp_replace(html, '<script[^>]*>(.|\n)*?</script>', '', 'g')) AS cleaned FROM pages")
def svg_script_strip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_scripts(F.col("html"))).alias("cleaned"))


@_query("""SELECT page_id, CAST(2 - page_id % 2 AS INTEGER) AS external, CASE WHEN page_id % 2 = 1 THEN '' ELSE '' END || ' p{background:url(' || CASE WHEN page_id % 2 = 1 THEN '#b' || page_id ELSE 'about:blank' END || ')} q{fill:url(#a' || page_id || ')}' AS cleaned,
  ' p{background:url(' || CASE WHEN page_id % 2 = 1 THEN '#b' || page_id ELSE 'about:blank' END || ')} q{fill:url(#a' || page_id || ')}' AS native FROM pages""")
def css_neutralize(spark, sf_dir):
    """Style sheets that import, fetch (even ids) and refer to parts of the page, which stay."""
    id = F.col("page_id").cast("string")
    fetched = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('URL( "'), "url", F.lit('" )'))).otherwise(F.concat(F.lit("url(#b"), id, F.lit(")")))
    sheet = F.concat(F.lit('@import "x.css"; p{background:'), fetched, F.lit("} q{fill:url(#a"), id, F.lit(")}"))
    pages = _table(spark, sf_dir, "pages").select("page_id", sheet.alias("css")).withColumn("native", text.neutral_css(F.col("css")))
    return markup_ops.neutral_styles(pages, "css", ["page_id", "native"]).select("page_id", "external", "cleaned", "native")


_FORMS = ("{}", "//{}", "java&#115;cript:{}", " HTTPS://{}", "#{}", "data:{}", "&#x68;ttp:{}", "ja\tvascript:{}", "img/{}")
_OUT = ("starts_with(url, 'http')", "true", "true", "true", "false", "false", "true", "true", "false")


@_query("SELECT page_id, CASE page_id % 9 " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(_OUT)) + " END AS external FROM pages")
def external_ref_flag(spark, sf_dir):
    form = F.element_at(F.array(*[F.replace(F.lit(f), F.lit("{}"), F.col("url")) for f in _FORMS]), (F.pmod("page_id", F.lit(9)) + 1).cast("int"))
    return markup_ops.outside_references(_table(spark, sf_dir, "pages").select("page_id", form.alias("ref")), "ref", ["page_id"])


@_query("SELECT page_id, starts_with(url, 'http:') OR starts_with(url, 'https:') AS external FROM pages")
def external_ref_native(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.leaves_document(F.col("url")).alias("external"))


_ESC = "replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@_query(f"SELECT doc_id, CAST(CASE WHEN text = 'author' THEN 0 ELSE 1 END AS INTEGER) AS blanked, CAST(2 AS INTEGER) AS removed, '<w:ins w:author=\"author\" w:id=\"7\"><w:r/></w:ins>' AS cleaned FROM documents")
def xml_attr_blank(spark, sf_dir):
    x = F.concat(F.lit('<w:ins w:author="'), build.escaped(F.coalesce("text", F.lit(""))), F.lit('" w:date="2020-01-01" w:id="7"><w:r w:rsidR="00A1"/></w:ins>'))
    return markup_ops.scrub_xml_attributes(_table(spark, sf_dir, "documents").select("doc_id", x.alias("x")), "x", ["doc_id"])


@_query("SELECT doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS removed, '<s><k>' || doc_id || '</k></s>' AS cleaned FROM documents")
def xml_elem_remove(spark, sf_dir):
    inner = F.concat(F.lit("<rsids>"), build.escaped(F.coalesce("text", F.lit(""))), F.lit("</rsids>"))
    x = F.concat(F.lit("<s><w:rsids>"), F.lit("t</w:rsids><k>"), F.col("doc_id").cast("string"), F.lit("</k>"), F.repeat(inner, F.pmod("doc_id", F.lit(3)).cast("int")), F.lit("</s>"))
    return markup_ops.remove_xml_elements(_table(spark, sf_dir, "documents").select("doc_id", x.alias("x")), "x", ["doc_id"], ["rsids"])


@_query("SELECT doc_id, CAST(CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0 ELSE 1 END AS INTEGER) AS blanked FROM documents")
def xml_text_blank(spark, sf_dir):
    x = F.concat(F.lit("<c><author>"), build.escaped(F.coalesce("text", F.lit(""))), F.lit("</author></c>"))
    return markup_ops.blank_xml_text(_table(spark, sf_dir, "documents").select("doc_id", x.alias("x")), "x", ["doc_id"], ["author"]).select("doc_id", "blanked")


@_query(
    "SELECT doc_id, CAST("
    + " + ".join(f"CASE WHEN contains(lower({_ESC} || k), '{m.lower()}') THEN 1 ELSE 0 END" for m, _ in MARKERS)
    + f" AS BIGINT) AS n_removed, contains(lower({_ESC} || k), 'exif:gps') AS found_location, CAST(237 AS BIGINT) AS output_len"
    + " FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'DC:Creator' WHEN 1 THEN 'exif:GPSLatitude xmpMM:History' ELSE '' END AS k FROM documents)"
)
def xmp_markers(spark, sf_dir):
    k = F.when(F.pmod("doc_id", F.lit(3)) == 0, "DC:Creator").when(F.pmod("doc_id", F.lit(3)) == 1, "exif:GPSLatitude xmpMM:History").otherwise("")
    r = inspect(_docs(spark, sf_dir, build.xmp_with(F.concat(F.coalesce("text", F.lit("")), k))), ["doc_id"])
    return r.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "found_location", "output_len")


# --- containers ----------------------------------------------------------------------------------


@_query(_expected("PNG", "complete", "1", "'comment'", f"7 + {_LEN}", str(len(build.BARE_PNG))))
def png_text_removed(spark, sf_dir):
    return _facts(_docs(spark, sf_dir, build.png_with(build.png_chunk(b"tEXt", F.concat(build.lit(b"Author\0"), build.text_bytes())))))


@_query("SELECT doc_id, true AS bare, true AS verified FROM documents")
def png_rebuild_identity(spark, sf_dir):
    extra = build.png_chunk(b"tEXt", F.concat(build.lit(b"Author\0"), build.text_bytes()))
    r = scrub(_docs(spark, sf_dir, build.png_with(extra, build.text_bytes())), ["doc_id"], verify=True)
    return r.select("doc_id", (F.col("data") == build.lit(build.BARE_PNG)).alias("bare"), F.col("verification.passed").alias("verified"))


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'malformed' END AS error FROM documents")
def png_crc_error(spark, sf_dir):
    body = build.text_bytes()
    sound = build.png_chunk(b"PLTE", body)
    broken = F.concat(build.be(F.length(body)), build.lit(b"PLTE"), body, build.be(F.crc32(body).bitwiseXOR(F.crc32(F.concat(build.lit(b"PLTE"), body))).bitwiseXOR(F.crc32(body)).bitwiseXOR(F.lit(1).cast("long"))))
    r = inspect(_docs(spark, sf_dir, build.png_with(F.when(F.pmod("doc_id", F.lit(2)) == 0, broken).otherwise(sound))), ["doc_id"])
    return r.select("doc_id", F.col("error.class").alias("error"))


@_query(_expected("PNG", "complete", f"CASE WHEN {_LEN} > 0 THEN 1 ELSE 0 END", f"CASE WHEN {_LEN} > 0 THEN 'trailing data' ELSE '' END", _LEN, str(len(build.BARE_PNG))))
def png_trailer(spark, sf_dir):
    return _facts(_docs(spark, sf_dir, build.png_with(build.lit(b""), build.text_bytes())))


_BARE_JPEG = len(build.JPEG_HEAD + build.JPEG_TAIL)


@_query(_expected("JPEG", "complete", f"(({_LEN}) + 65532) // 65533", f"array_to_string(list_transform(range(({_LEN} + 65532) // 65533), lambda i: 'comment'), ',')", _LEN, str(_BARE_JPEG)))
def jpeg_comment_removed(spark, sf_dir):
    return _facts(_docs(spark, sf_dir, build.jpeg_with_comments(build.text_bytes())))


_APPS = ((0xE1, b"http://ns.adobe.com/xap/1.0/\0", "XMP"), (0xE2, b"ICC_PROFILE\0", "colour profile"), (0xE2, b"MPF\0", "thumbnail"), (0xED, b"Photoshop 3.0\0", "IPTC"), (0xE7, b"own", "unrecognised structure"), (0xE0, b"JFXX\0", "thumbnail"))


_PIECE = 60_000
_PIECES = f"(1 + strlen(coalesce(text, '')) // {_PIECE})"


@_query(
    "SELECT conv_id, turn, CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, _, k) in enumerate(_APPS)) + " END AS kind, CAST(strlen(coalesce(text, '')) + "
    + f"{_PIECES} * CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN {len(p)}" for i, (_, p, _) in enumerate(_APPS)) + f" END AS BIGINT) AS bytes, CAST({_PIECES} AS BIGINT) AS segments FROM conversations"
)
def jpeg_app_classify(spark, sf_dir):
    body = build.text_bytes()
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(body) / _PIECE).cast("int")), lambda i: F.substring(body, i * _PIECE + 1, F.lit(_PIECE)))

    def segments(marker: int, prefix: bytes) -> Column:
        return F.unhex(F.array_join(F.transform(pieces, lambda x: F.hex(build.jpeg_segment(marker, F.concat(build.lit(prefix), x)))), ""))

    made = F.coalesce(*[F.when(F.pmod("conv_id", F.lit(6)) == i, segments(m, p)) for i, (m, p, _) in enumerate(_APPS)])
    jpegs = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(build.lit(build.JPEG_HEAD), made, build.lit(build.JPEG_TAIL)).alias("content"))
    r = inspect(jpegs, ["conv_id", "turn"])
    return r.select("conv_id", "turn", F.col("removed")[0]["kind"].alias("kind"), report.bytes_removed().alias("bytes"), F.size("removed").cast("long").alias("segments"))


@_query(_expected("JPEG", "complete", "1", "CASE WHEN doc_id % 2 = 0 THEN 'thumbnail' ELSE 'trailing data' END", f"8 + {_LEN}", str(_BARE_JPEG)))
def jpeg_trailer_video(spark, sf_dir):
    tail = F.concat(F.when(F.pmod("doc_id", F.lit(2)) == 0, build.lit(b"\0\0\0\x18ftyp")).otherwise(build.lit(b"\0\0\0\x18free")), F.translate("text", "fM", "gN").cast("binary"))
    return _facts(_docs(spark, sf_dir, F.concat(build.lit(build.JPEG_HEAD + build.JPEG_TAIL), tail)))


_BARE_GIF = len(build.GIF_HEAD + build.GIF_TAIL)


@_query(_expected("GIF", "complete", "1", "'comment'", _LEN, str(_BARE_GIF)))
def gif_comment_removed(spark, sf_dir):
    return _facts(_docs(spark, sf_dir, build.gif_with_comment(build.text_bytes())))


@_query(f"SELECT doc_id, doc_id % 1000 AS loops, CAST(1 AS BIGINT) AS n_removed, CAST({_LEN} AS BIGINT) AS bytes_removed, CAST({_BARE_GIF} + 19 AS BIGINT) AS output_len FROM documents")
def gif_loop_kept(spark, sf_dir):
    """Animations: the loop count stays, the comment behind it goes."""
    loop = F.concat(build.lit(b"\x21\xff\x0bNETSCAPE2.0\x03\x01"), build.le(F.pmod("doc_id", F.lit(1000)), 2), build.lit(b"\0"))
    bare = build.gif_with_comment(build.text_bytes())
    content = F.concat(build.lit(build.GIF_HEAD), loop, F.substring(bare, F.lit(len(build.GIF_HEAD) + 1), F.length(bare)))
    r = scrub(_docs(spark, sf_dir, content), ["doc_id"])
    return r.select("doc_id", binary.little_endian(F.col("data"), len(build.GIF_HEAD) + 16, 2).alias("loops"), F.size("removed").cast("long").alias("n_removed"), report.bytes_removed().alias("bytes_removed"), "output_len")


@_query(f"SELECT doc_id, 'camera raw' AS format, 'none' AS assurance, CAST(0 AS BIGINT) AS n_removed, '' AS kinds, CAST(0 AS BIGINT) AS bytes_removed, CAST(4 + {_LEN} AS BIGINT) AS output_len FROM documents")
def x3f_left_alone(spark, sf_dir):
    return _facts(_docs(spark, sf_dir, F.concat(build.lit(b"FOVb"), build.text_bytes())))


_SEGMENTS = f"(({_LEN} + 65532) // 65533)"


@_query(
    f"SELECT doc_id, 'camera raw' AS format, 'best effort' AS assurance, CAST({_SEGMENTS} AS BIGINT) AS n_removed, rtrim(repeat('comment,', CAST({_SEGMENTS} AS INTEGER)), ',') AS kinds, CAST({_LEN} AS BIGINT) AS bytes_removed, "
    f"CAST(92 + {len(build.JPEG_HEAD + build.JPEG_TAIL)} + {_LEN} + 4 * {_SEGMENTS} AS BIGINT) AS output_len FROM documents"
)
def raf_preview_blanked(spark, sf_dir):
    """Raws whose preview lies behind an offset in the header: its comments are blanked, the length stays."""
    preview = build.jpeg_with_comments(build.text_bytes())
    return _facts(_docs(spark, sf_dir, F.concat(build.lit(b"FUJIFILMCCD-RAW ".ljust(84, b"\0") + (92).to_bytes(4, "big")), build.be(F.length(preview)), preview)))


@_query("""SELECT doc_id, '<o><dc:creator>' || CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN coalesce(text, '') ELSE 'author' END || '</dc:creator><p>' || doc_id || '</p></o>' AS content FROM documents""")
def opendocument_cleaned(spark, sf_dir):
    """The content part of a cleaned OpenDocument file, read back from the archive."""
    inner = build.escaped(F.coalesce("text", F.lit("")))
    content = F.encode(F.concat(F.lit("<o><dc:creator>"), inner, F.lit("</dc:creator><p>"), F.col("doc_id").cast("string"), F.lit("</p></o>")), "UTF-8")
    meta = F.encode(F.concat(F.lit("<office:document-meta><dc:creator>"), inner, F.lit("</dc:creator></office:document-meta>")), "UTF-8")
    odt = build.zip_stored([("mimetype", build.lit(b"application/vnd.oasis.opendocument.text")), ("content.xml", content), ("meta.xml", meta)])
    r = scrub(_docs(spark, sf_dir, odt), ["doc_id"]).filter("format = 'OpenDocument'").select("doc_id", F.col("data").alias("content"))
    return files.members(r, ["doc_id"]).filter("member = 'content.xml'").select("doc_id", F.col("data").cast("string").alias("content"))


@_query(f"SELECT doc_id, '{generation(Policy())}' AS generation, CAST(1 AS BIGINT) AS n_removed, CAST({_LEN} AS BIGINT) AS bytes_removed FROM documents")
def stream_scrubbed(spark, sf_dir):
    """The documents as a stream of pictures, each arriving twice and let through once."""
    path = f"{sf_dir}/documents.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may name one file, a path must be a folder
    content = build.png_with(build.png_chunk(b"tEXt", build.text_bytes()))
    arriving = rows.select("doc_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("path"), F.timestamp_seconds(F.col("doc_id") + 1).alias("modificationTime"), content.alias("content"), F.explode(F.array(F.lit(1), F.lit(2))).alias("time")).drop("time")
    done = run_available(scrub_stream(once(arriving, "100000 days"), Policy(), emit=False))
    return current(done, Policy()).select("doc_id", "generation", F.size("removed").cast("long").alias("n_removed"), report.bytes_removed().alias("bytes_removed"))


@_query(_expected("WebP", "complete", "2", "'XMP,unrecognised structure'", f"2 * {_LEN}", "24"))
def webp_chunk_filter(spark, sf_dir):
    return _facts(_docs(spark, sf_dir, build.webp_with(F.concat(build.riff_chunk(b"XMP ", build.text_bytes()), build.riff_chunk(b"note", build.text_bytes())))))


@_query("SELECT doc_id, 'TIFF' AS format, 'document info' AS kinds, true AS pixels, true AS gone FROM documents")
def tiff_tag_filter(spark, sf_dir):
    r = scrub(_docs(spark, sf_dir, build.tiff_with(270, F.concat(build.lit(b"desc:"), build.text_bytes(), build.lit(b"\0")))), ["doc_id"])
    kinds = F.array_join(F.transform("removed", lambda x: x["kind"]), ",")
    return r.select("doc_id", "format", kinds.alias("kinds"), (F.substring(F.col("data"), -4, 4) == build.lit(build.STRIP)).alias("pixels"), (F.position(build.lit(b"desc:"), F.col("data")) == 0).alias("gone"))


@_query(f"SELECT doc_id, 'camera raw' AS format, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 9 + {_LEN} END AS BIGINT) AS zeroed, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_retained, true AS same_length FROM documents")
def raw_range_zero(spark, sf_dir):
    value = F.concat(build.lit(b"software"), build.text_bytes(), build.lit(b"\0"))
    r = inspect(_docs(spark, sf_dir, build.tiff_with(0x0131, F.concat(value), True, F.pmod("doc_id", F.lit(2)) == 0)), ["doc_id"])
    return r.select("doc_id", "format", report.bytes_removed().alias("zeroed"), F.size("retained").cast("long").alias("n_retained"), (F.col("input_len") == F.col("output_len")).alias("same_length"))


@_query(f"SELECT doc_id, 'HEIF' AS format, 'best effort' AS assurance, CAST(4 + {_LEN} AS BIGINT) AS bytes_removed, 'HEIF_ITEM_NO_LOCATION,HEIF_OVERWRITTEN' AS warnings, true AS gone FROM documents")
def heif_item_extent_join(spark, sf_dir):
    item = F.concat(build.lit(b"\0\0\0\0"), build.text_bytes())
    r = scrub(_docs(spark, sf_dir, build.heif_with_exif(item), "text"), ["doc_id", "text"])
    gone = (F.length("text") < 16) | (F.position(build.text_bytes(), F.col("data")) == 0)
    return r.select("doc_id", "format", report.assurance_label().alias("assurance"), report.bytes_removed().alias("bytes_removed"), F.array_join("warnings", ",").alias("warnings"), gone.alias("gone"))


@_query(f"SELECT doc_id, member, CAST(size AS BIGINT) AS size FROM (SELECT doc_id, unnest(['[Content_Types].xml', 'docProps/core.xml', 'word/document.xml']) AS member, unnest([8, strlen({_ESC}) + {len('<cp:coreProperties><dc:creator></dc:creator></cp:coreProperties>')}, {len('<w:document><w:p/></w:document>')}]) AS size FROM documents)")
def zip_parts_explode(spark, sf_dir):
    return files.members(_docs(spark, sf_dir, build.docx_with(F.coalesce("text", F.lit("")))), ["doc_id"]).select("doc_id", "member", F.length("data").cast("long").alias("size"))


@_query("SELECT doc_id, 'OOXML' AS format, 'archive entry metadata,document info' AS kinds, true AS gone FROM documents")
def ooxml_core_replaced(spark, sf_dir):
    creator = F.concat(F.lit("canary-"), F.coalesce("text", F.lit("")))
    r = scrub(_docs(spark, sf_dir, build.docx_with(creator)), ["doc_id"])
    return r.select("doc_id", "format", F.array_join(F.transform("removed", lambda x: x["kind"]), ",").alias("kinds"), (F.position(build.lit(b"canary-"), F.col("data")) == 0).alias("gone"))


@_query(f"SELECT doc_id, 'word/media/image1.png → tEXt' AS location, CAST({_LEN} AS BIGINT) AS bytes FROM documents")
def ooxml_nested_image(spark, sf_dir):
    picture = build.png_with(build.png_chunk(b"tEXt", build.text_bytes()))
    r = inspect(_docs(spark, sf_dir, build.docx_with(F.lit("x"), picture)), ["doc_id"])
    return report.findings(r, "doc_id").filter("kind = 'comment'").select("doc_id", "location", "bytes")


@_query("SELECT doc_id, 'PDF' AS format, 'document info,timestamp,author identity,document info' AS kinds, true AS gone FROM documents")
def pdf_info_removed(spark, sf_dir):
    r = scrub(_docs(spark, sf_dir, build.pdf_with(F.concat(build.lit(b"canary"), build.text_bytes()))), ["doc_id"])
    gone = F.position(F.encode(F.hex(build.lit(b"canary")), "UTF-8"), F.col("data")) == 0
    return r.select("doc_id", "format", F.array_join(F.transform("removed", lambda x: x["kind"]), ",").alias("kinds"), gone.alias("gone"))


# --- reports -------------------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as five kinds of files by id: PNG, JPEG, GIF, WebP and plain text."""
    body = build.text_bytes()
    made = [
        build.png_with(build.png_chunk(b"tEXt", body), build.lit(b"tail")), build.jpeg_with_comments(F.concat(build.lit(b"c"), body)), build.gif_with_comment(body),
        build.webp_with(build.riff_chunk(b"XMP ", body)), F.concat(build.lit(b"plain "), body),
    ]
    content = F.coalesce(*[F.when(F.pmod("doc_id", F.lit(5)) == i, c) for i, c in enumerate(made)])
    return _docs(spark, sf_dir, content)


_MIXED = f"""
WITH found AS (
  SELECT doc_id, 'PNG' AS format, 0 AS assurance, unnest(['comment', 'trailing data']) AS kind, unnest([{_LEN}, 4]) AS bytes FROM documents WHERE doc_id % 5 = 0 UNION ALL
  SELECT doc_id, 'JPEG', 0, 'comment', unnest(list_transform(range(({_LEN} + 65533) // 65533), lambda i: least(65533, {_LEN} + 1 - 65533 * i))) FROM documents WHERE doc_id % 5 = 1 UNION ALL
  SELECT doc_id, 'GIF', 0, 'comment', {_LEN} FROM documents WHERE doc_id % 5 = 2 UNION ALL
  SELECT doc_id, 'WebP', 0, 'XMP', {_LEN} FROM documents WHERE doc_id % 5 = 3),
files AS (SELECT doc_id, ['PNG', 'JPEG', 'GIF', 'WebP', 'unknown format'][doc_id % 5 + 1] AS format, CASE WHEN doc_id % 5 = 4 THEN 2 ELSE 0 END AS assurance FROM documents)
"""


@_query(_MIXED + "SELECT CAST(CASE kind WHEN 'XMP' THEN 1 WHEN 'comment' THEN 6 ELSE 7 END AS INTEGER) AS kind_ord, kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM found GROUP BY ALL")
def report_by_kind(spark, sf_dir):
    return report.by_kind(inspect(_mixed(spark, sf_dir), ["doc_id"]))


@_query(_MIXED + "SELECT format, kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM found GROUP BY ROLLUP (format, kind)")
def report_by_format_rollup(spark, sf_dir):
    return report.by_format_and_kind(inspect(_mixed(spark, sf_dir), ["doc_id"]))


@_query(_MIXED + "SELECT format, count(*) FILTER (assurance = 0) AS complete, count(*) FILTER (assurance = 1) AS partial, count(*) FILTER (assurance = 2) AS skipped, false AS any_location FROM files GROUP BY format")
def assurance_buckets(spark, sf_dir):
    return report.assurance_buckets(inspect(_mixed(spark, sf_dir), ["doc_id"]))


@_query(_MIXED + "SELECT CAST(max(assurance) AS INTEGER) AS assurance, false AS found_location, CAST(max(assurance) AS INTEGER) AS exit_code FROM files")
def worst_assurance(spark, sf_dir):
    return report.worst(inspect(_mixed(spark, sf_dir), ["doc_id"]))


@_query(_MIXED + "SELECT doc_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM found GROUP BY doc_id ORDER BY bytes DESC, doc_id LIMIT 20")
def top_files_by_bytes(spark, sf_dir):
    r = inspect(_mixed(spark, sf_dir), ["doc_id"])
    return r.select("doc_id", report.bytes_removed().alias("bytes")).orderBy(F.desc("bytes"), "doc_id").limit(20)


@_query(f"""SELECT doc_id, '{{"file":"' || doc_id || '.png","format":"PNG","assurance":"complete","found_location":false,"input_bytes":' || ({len(build.BARE_PNG)} + 12 + {_LEN}) || ',"output_bytes":{len(build.BARE_PNG)},"removed":[{{"kind":"comment","location":"tEXt","bytes":' || {_LEN} || '}}],"retained":[],"warnings":[]}}' AS json FROM documents""")
def findings_json(spark, sf_dir):
    r = inspect(_docs(spark, sf_dir, build.png_with(build.png_chunk(b"tEXt", build.text_bytes()))), ["doc_id"])
    return r.select("doc_id", report.as_json(F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("json"))


@_query(f"""SELECT doc_id, '{{"format":"GIF","assurance":"complete","found_location":false,"input_bytes":' || ({_BARE_GIF} + 3 + {_LEN} + ({_LEN} + 254) // 255) || ',"output_bytes":{_BARE_GIF},"removed":[{{"kind":"comment","location":"comment extension","bytes":' || {_LEN} || '}}],"retained":[],"warnings":[]}}' AS json FROM documents""")
def findings_json_bridge(spark, sf_dir):
    r = inspect(_docs(spark, sf_dir, build.gif_with_comment(build.text_bytes())), ["doc_id"])
    return r.select("doc_id", report.as_json(F.lit(""), bridge=True).alias("json"))


@_query(f"""SELECT doc_id, 'PNG | findings=1 bytes=' || {_LEN} || ' assurance=complete' || chr(10) || 'gone' || chr(9) || 'comment' || chr(9) || 'tEXt (' || {_LEN} || ')' ||
  chr(10) || 'check' || chr(9) || 'second pass finds nothing' || chr(9) || 'true' || chr(10) || 'check' || chr(9) || 'second pass gives the same bytes' || chr(9) || 'true' AS report FROM documents""")
def report_text(spark, sf_dir):
    r = scrub(_docs(spark, sf_dir, build.png_with(build.png_chunk(b"tEXt", build.text_bytes()))), ["doc_id"], verify=True)
    return r.select("doc_id", report.as_text().alias("report"))


@_query(_MIXED + "SELECT f.doc_id FROM files f LEFT JOIN found USING (doc_id) WHERE found.kind IS NOT NULL OR f.assurance = 2 GROUP BY f.doc_id")
def quiet_filter(spark, sf_dir):
    return report.loud(inspect(_mixed(spark, sf_dir), ["doc_id"])).select("doc_id")


@_query(_MIXED + "SELECT doc_id FROM files WHERE assurance < 2")
def writable_rows(spark, sf_dir):
    return report.writable(inspect(_mixed(spark, sf_dir), ["doc_id"])).select("doc_id")


@_query(_MIXED + """SELECT source AS parent_id, CAST(max(assurance) AS INTEGER) AS assurance, false AS found_location, CAST(sum(n) AS BIGINT) AS n_removed, CAST(sum(b) AS BIGINT) AS bytes
FROM (SELECT source, f.assurance, count(found.kind) AS n, coalesce(sum(bytes), 0) AS b FROM documents d JOIN files f USING (doc_id) LEFT JOIN found USING (doc_id) GROUP BY d.doc_id, source, f.assurance) GROUP BY source""")
def nested_absorption(spark, sf_dir):
    r = inspect(_mixed(spark, sf_dir), ["doc_id"]).join(_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("parent_id")), "doc_id")
    out = report.absorbed(r.filter("doc_id % 2 = 0"), r.filter("doc_id % 2 <> 0"))
    return out.withColumn("assurance", F.col("assurance").cast("int"))


@_query("SELECT doc_id, true AS passed FROM documents WHERE doc_id % 5 < 4")
def verify_fixed_point(spark, sf_dir):
    r = scrub(_mixed(spark, sf_dir), ["doc_id"], verify=True, emit=False)
    return r.filter("verification is not null").select("doc_id", F.col("verification.passed").alias("passed"))


_UNIT = "CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024.0 < 1024 THEN printf('%.1f kB', n::DOUBLE / 1024) ELSE printf('%.1f MB', n::DOUBLE / 1024 / 1024) END"


@_query(f"SELECT page_id, {_UNIT} AS size FROM (SELECT page_id, strlen(html) AS n FROM pages)")
def human_sizes(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", report.human_size(F.octet_length("html")).alias("size"))


# --- files and names -----------------------------------------------------------------------------

_PATHS = "'/d' || (doc_id // 3 % 7) || '/p' || (doc_id // 3) || CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.xmp' ELSE '.jpg.XMP' END"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    end = F.element_at(F.array(F.lit(".jpg"), F.lit(".xmp"), F.lit(".jpg.XMP")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("/d"), F.pmod(F.floor(F.col("doc_id") / 3), F.lit(7)).cast("string"), F.lit("/p"), F.floor(F.col("doc_id") / 3).cast("string"), end).alias("path"))


@_query(f"""
WITH p AS (SELECT doc_id, {_PATHS} AS path FROM documents), j AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, 'p[0-9]+') AS stem FROM p)
SELECT a.path, b.path AS sidecar FROM j a JOIN j b ON a.dir = b.dir AND a.stem = b.stem WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0""")
def sidecar_pairs(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return files.sidecars(p.filter("doc_id % 3 = 0").select("path"), p.select("path"))


@_query(f"SELECT path, regexp_replace(path, '\\.([^./]*)$', '.clean.\\1') AS clean, CAST(24 AS INTEGER) AS stem, true AS beside FROM (SELECT {_PATHS} AS path FROM documents)")
def clean_names(spark, sf_dir):
    path = F.col("path")
    name = export.random_name(path, F.lit("seed"))
    return _paths(spark, sf_dir).select("path", export.clean_name(path).alias("clean"), F.length(F.regexp_extract(name, "/([a-z2-7]+)\\.[^/]*$", 1)).alias("stem"), (text.folder(name) == text.folder(path)).alias("beside"))


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def handbook_search(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter(text.matches_search("LICENSE", F.col("text"), F.col("source"))).select("doc_id")


@_query("SELECT doc_id, lang AS category FROM documents WHERE lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(source), 'license'))")
def handbook_in_category(spark, sf_dir):
    """Documents as a handbook: those of one category that hold a text."""
    entries = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.col("source").alias("title"), F.col("text").alias("body"))
    return handbook.search(entries, "LICENSE", "en").select("doc_id", "category")


# --- functions -----------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_orderkey AS be4, o_orderkey AS le4, (o_orderkey % 65536) AS le2, CAST(NULL AS BIGINT) AS beyond FROM orders")
def endian_reads(spark, sf_dir):
    k = F.col("o_orderkey")
    b = F.concat(build.be(k), build.le(k), build.le(F.pmod(k, F.lit(65536)), 2))
    return _table(spark, sf_dir, "orders").select(
        k, binary.big_endian(b, 0, 4).alias("be4"), binary.little_endian(b, 4, 4).alias("le4"), binary.little_endian(b, 8, 2).alias("le2"), binary.big_endian(b, 9, 4).alias("beyond")
    )


@_query("""SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN abs(v) <= 0.1::DOUBLE THEN 0 WHEN v > 0 THEN v - 0.1::DOUBLE ELSE v + 0.1::DOUBLE END, 6) AS soft
FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)""")
def soft_threshold_embeddings(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return v.select("vec_id", "i", F.round(pixels.soft_threshold(F.col("v").cast("double"), 0.1), 6).alias("soft"))


@_query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_concat(embedding[2:], embedding[:1])::DOUBLE[] AS b FROM embeddings),
c AS (SELECT vec_id, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM p)
SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS r FROM c""")
def pattern_correlation(spark, sf_dir):
    """Each embedding against itself moved by one place."""
    v = _table(spark, sf_dir, "embeddings").withColumn("moved", F.expr("concat(slice(embedding, 2, size(embedding)), slice(embedding, 1, 1))"))
    return v.select("vec_id", F.round(pixels.correlation(F.col("embedding"), F.col("moved")), 6).alias("r"))


@_query("""
WITH z AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + 3 AS e FROM lineitem),
p AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS BIGINT) AS s, CAST(o_orderkey % 50 AS BIGINT) + 5 AS e FROM orders)
SELECT l_orderkey, l_linenumber FROM z WHERE NOT EXISTS (SELECT 1 FROM p WHERE o_orderkey = l_orderkey AND z.s < p.e AND p.s < z.e)""")
def range_anti_join(spark, sf_dir):
    start = F.col("l_quantity").cast("long")
    z = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber", start.alias("start"), (start + 3).alias("end"))
    at = F.pmod("o_orderkey", F.lit(50)).cast("long")
    p = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), at.alias("start"), (at + 5).alias("end"))
    return intervals.overlap_anti_join(z, p, ["file"], ["file", "start"]).select(F.col("file").alias("l_orderkey"), "l_linenumber")


@_query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_of_group(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return _table(spark, sf_dir, "documents").select("source", "doc_id", k.alias("k")).filter("k = 1").select("source", "doc_id")


def _rasters(spark: SparkSession, sf_dir: str, *chunks: Column) -> DataFrame:
    """Embeddings as grey pictures, 1 to 60 pixels wide by the id, of five equal lines; ``chunks`` come after the header."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.expr("slice(embedding, 1, cast(1 + pmod(vec_id, 60) as int))").alias("embedding"))
    line = F.unhex(F.concat(F.lit("00"), F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(F.pmod(F.floor(v.cast("double") * 1000), F.lit(256)).cast("long")), 2, "0")), "")))
    lines = F.concat(*[line] * 5)
    stored = F.concat(build.lit(b"\x78\x01\x01"), build.le(F.length(lines), 2), build.le(F.lit(0xFFFF) - F.length(lines), 2), lines)
    head = build.png_chunk(b"IHDR", F.concat(build.be(F.size("embedding")), build.lit(b"\0\0\0\5\x08\0\0\0\0")))
    content = F.concat(build.lit(build.png.MAGIC), head, *chunks, build.png_chunk(b"IDAT", stored), build.lit(build.PIXEL[2]))
    return v.select("vec_id", content.alias("content"))


_WIDTH = "(1 + vec_id % 60)"


@_query(f"""SELECT vec_id, CAST({_WIDTH} AS INTEGER) AS w, CAST(5 AS INTEGER) AS h, CAST(greatest(1, round_even({_WIDTH} * CAST(0.7 AS DOUBLE), 0)) AS INTEGER) AS new_w, CAST(4 AS INTEGER) AS new_h FROM embeddings""")
def wash_rasters(spark, sf_dir):
    washed = pixels.wash_files(_rasters(spark, sf_dir), ["vec_id"])
    return washed.select("vec_id", F.col("orig_w").alias("w"), F.col("orig_h").alias("h"), F.col("new_w"), F.col("new_h"))


@_query(f"""SELECT vec_id, 'PNG' AS format, CAST(1 AS BIGINT) AS n_removed, CAST(7 + length(CAST(vec_id AS VARCHAR)) AS BIGINT) AS bytes_removed, 'complete' AS assurance, true AS verified, true AS output_measured,
  CAST(88 + {_WIDTH} * 5 + length(CAST(vec_id AS VARCHAR)) AS BIGINT) AS input_len FROM embeddings""")
def wash_then_scrub(spark, sf_dir):
    """Pictures with a comment, washed and scrubbed again: the report names the original's comment, its other facts are the washed file's."""
    comment = build.png_chunk(b"tEXt", F.concat(build.lit(b"Author\0"), F.col("vec_id").cast("string").cast("binary")))
    r = pixels.wash_and_scrub(_rasters(spark, sf_dir, comment), ["vec_id"])
    return r.select(
        "vec_id", "format", F.size("removed").cast("long").alias("n_removed"), report.bytes_removed().alias("bytes_removed"), report.assurance_label().alias("assurance"), F.col("verification.passed").alias("verified"),
        (F.col("output_len") == F.length("data")).alias("output_measured"), F.col("input_len"),
    )


@_query(f"""SELECT vec_id, CAST(CASE WHEN {_WIDTH} <= 16 THEN {_WIDTH} ELSE 16 END AS INTEGER) AS width, CAST(CASE WHEN {_WIDTH} <= 16 THEN 5 ELSE greatest(1, round_even(5 * (CAST(16.0 AS DOUBLE) / {_WIDTH}), 0)) END AS INTEGER) AS height, CAST(NULL AS VARCHAR) AS error_class FROM embeddings""")
def png_within_edge(spark, sf_dir):
    return pixels.to_png_files(_rasters(spark, sf_dir), ["vec_id"], max_edge=16).select("vec_id", "width", "height", "error_class")


_KINDS = ("AVIF", "HEIF", "audio", "video", "camera raw", "camera raw", "camera raw", "camera raw", "TIFF", "camera raw")


@_query(f"SELECT doc_id, [{', '.join(repr(k) for k in _KINDS)}][doc_id % {len(_KINDS)} + 1] AS format FROM documents")
def detect_probed(spark, sf_dir):
    """Files whose leading bytes do not decide: ISO media brands in several orders, raws and a TIFF by their directories."""

    def media(*brands: bytes) -> Column:
        return F.concat(build.lit((8 + 4 * len(brands) + 4).to_bytes(4, "big") + b"ftyp" + brands[0] + b"\0\0\0\0" + b"".join(brands[1:])), build.text_bytes())

    def tiff(tag: int, kind: int, count: int) -> Column:
        return F.concat(build.lit(b"II*\0\x08\0\0\0\x01\0" + tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + count.to_bytes(4, "little") + b"\1\0\0\0" + b"\0" * 4), build.text_bytes())

    forms = [
        media(b"mif1", b"avif"), media(b"heic", b"mif1", b"isom"), media(b"isom", b"M4A "), media(b"isom", b"mp42"), media(b"crx ", b"isom"), F.concat(build.lit(b"IIU\0" + b"\x18\0\0\0" + b"\0" * 16), build.text_bytes()),
        F.concat(build.lit(b"IIRO\x08\0\0\0\0\0"), build.text_bytes()), tiff(0xC612, 1, 4), tiff(0x0100, 3, 1), F.concat(build.lit(b"II*\0\x10\0\0\0CR\2\0" + b"\0" * 8), build.text_bytes()),
    ]
    content = F
    for i, form in enumerate(forms):
        content = content.when(F.col("doc_id") % len(forms) == i, form)
    return detect_files(_table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), ["doc_id"])


@_query("""SELECT doc_id, doc_id % 7 IN (0, 1, 2, 3) AS by_name, doc_id % 5 IN (0, 1, 2) AS by_type FROM documents""")
def washable_by_name_and_type(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in (".jpg", ".JPEG", ".Png", ".webp", ".heic", "", ".png.txt")])
    types = F.array(*[F.lit(t) for t in ("image/jpeg", "image/png", "image/webp", "image/gif", None)])
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("file-"), F.col("doc_id").cast("string"), F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int"))).alias("path"), F.element_at(types, (F.col("doc_id") % 5 + 1).cast("int")).alias("mime"))
    return d.select("doc_id", pixels.washable_name(F.col("path")).alias("by_name"), pixels.washable_type(F.col("mime")).alias("by_type"))


@_query("""SELECT * FROM (VALUES ('files', 16), ('metadata', 15), ('raw', 2), ('fingerprint', 2), ('beyond_file', 3), ('myths', 2), ('evidence', 2), ('letter', 1)) AS t(category, n), (VALUES (true)) AS e(nothing_found)""")
def handbook_sections(spark, sf_dir):
    """Entries of each of the eight sections, and whether the first nation's name is in none of them."""
    h = handbook.handbook(spark)
    name = _table(spark, sf_dir, "nation").agg(F.min_by("n_name", "n_nationkey")).scalar()
    return h.groupBy("category").agg(F.count("*").cast("int").alias("n")).select("*", handbook.nothing_found(h, name).scalar().alias("nothing_found"))


# --- more functions and shapes -------------------------------------------------------------------


_BLURRED = "list_transform(range(1, len({0}) + 1), lambda i: list_avg(list_transform(range(i - 2, i + 3), lambda j: {0}[greatest(1, least(len({0}), j))])))"


@_query(f"""WITH p AS (SELECT vec_id, list_transform(embedding[1:1 + vec_id % 60], lambda v: CAST((CAST(floor(v::DOUBLE * 1000) AS BIGINT) % 256 + 256) % 256 AS DOUBLE)) AS line FROM embeddings),
one AS (SELECT vec_id, line, {_BLURRED.format("line")} AS once FROM p), two AS (SELECT vec_id, line, {_BLURRED.format("once")} AS smooth FROM one)
SELECT vec_id, CAST(round(sqrt(list_avg(list_transform(list_zip(line, smooth), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS DOUBLE) AS rms FROM two""")
def raster_residuals(spark, sf_dir):
    """Pictures of equal lines, decoded and blurred: the strength of what the blur leaves."""
    return pixels.residuals(_rasters(spark, sf_dir), ["vec_id"], 2).select("vec_id", F.round(F.col("rms")[0], 6).alias("rms"))


@_query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'FIELD_IN_IMAGE_DATA: EXIF' END AS what, count(*) AS files FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL")
def retained_by_what(spark, sf_dir):
    value = F.concat(build.lit(b"software"), build.text_bytes(), build.lit(b"\0"))
    r = inspect(_docs(spark, sf_dir, build.tiff_with(0x0131, value, True, F.pmod("doc_id", F.lit(2)) == 0)), ["doc_id"])
    return report.retained(r, "doc_id").groupBy("what").agg(F.count_distinct("doc_id").alias("files"))


@_query(_MIXED + "SELECT f.format, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, count(*) AS n FROM found JOIN files f USING (doc_id) GROUP BY f.format")
def distinct_kinds(spark, sf_dir):
    f = report.findings(inspect(_mixed(spark, sf_dir), ["doc_id"]), "doc_id")
    return f.groupBy("format").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"))


@_query(_MIXED + """SELECT n.k AS format, count(f.doc_id) AS files FROM (SELECT unnest(['JPEG', 'PNG', 'WebP', 'HEIF', 'AVIF', 'GIF', 'TIFF', 'SVG', 'XMP sidecar', 'camera raw', 'video', 'audio', 'PDF', 'OOXML', 'OpenDocument', 'ZIP', 'unknown format']) AS k) n
LEFT JOIN files f ON f.format = n.k GROUP BY n.k""")
def format_coverage(spark, sf_dir):
    return report.coverage(inspect(_mixed(spark, sf_dir), ["doc_id"])).select("format", "files")


@_query(_MIXED + "SELECT CASE WHEN format IN ('JPEG', 'PNG', 'WebP', 'TIFF', 'GIF') THEN 'ok' ELSE 'not_an_image' END AS washable, count(*) AS files FROM files GROUP BY ALL")
def wash_applicability(spark, sf_dir):
    r = inspect(_mixed(spark, sf_dir), ["doc_id"])
    return r.select(pixels.washable(F.col("format")).alias("washable")).groupBy("washable").agg(F.count("*").alias("files"))


@_query("""WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, s: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) t(i))),
b AS (SELECT o_orderkey, hex(encode('123456789-' || o_orderkey)) AS h FROM orders)
SELECT o_orderkey AS id, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) AS BIGINT) AS crc FROM b, tab""")
def crc32_vector(spark, sf_dir):
    """CRC-32 of a text for each order, through the expression every chunk writer uses."""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), binary.crc32(F.concat(F.lit("123456789-"), F.col("o_orderkey").cast("string")).cast("binary")).alias("crc"))


_PLACED = "doc_id % 3 = 1"


@_query(f"""SELECT file, CAST(2 AS INTEGER) AS worst, bool_or({_PLACED}) AS found_location, count(*) AS files, count(*) FILTER ({_PLACED}) AS placed
FROM (SELECT *, doc_id % 40 AS file FROM documents) GROUP BY file""")
def locations_by_folder(spark, sf_dir):
    """Pictures with a place in every third, and files that cannot be cleaned among them: what each folder's report says."""
    gps = bytes.fromhex("49492a00080000000100") + (2).to_bytes(2, "little") + bytes.fromhex("0500" "03000000" "00000000" "00000000")
    picture = build.png_with(F.concat(build.png_chunk(b"tEXt", build.text_bytes()), F.when(F.pmod("doc_id", F.lit(3)) == 1, build.png_chunk(b"eXIf", build.lit(gps))).otherwise(build.lit(b""))))
    r = inspect(_docs(spark, sf_dir, picture), ["doc_id"])
    plain = inspect(_docs(spark, sf_dir, F.concat(build.lit(b"plain "), build.text_bytes())), ["doc_id"])
    both = r.unionByName(plain).withColumn("file", F.pmod("doc_id", F.lit(40)))
    return both.groupBy("file").agg(F.max("assurance").cast("int").alias("worst"), F.bool_or("found_location").alias("found_location"), F.count_if(F.col("format") == "PNG").alias("files"), F.count_if(F.col("found_location")).alias("placed"))
