"""Queries whose work is joins, windows and folds over the structure of files: segments, ranges, elements, references."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text
from ..functions.sql import register
from ..operators import elements, intervals, lookup, reachability, repack, report, segments, tiles
from ..sources import archives, published
from ..streaming.latest import newest_policy
from ..streaming.scrub_stream import run_available
from . import build
from .registry import docs, expected, query, table

LEN = "strlen(coalesce(text, ''))"

# --- segments ------------------------------------------------------------------------------------


def _facts(files: DataFrame, format: str) -> DataFrame:
    r = segments.scrub_native(files, ["doc_id"], format)
    kinds = F.array_join(F.transform("removed", lambda x: x["kind"]), ",")
    return r.select("doc_id", "format", report.assurance_label().alias("assurance"), F.size("removed").cast("long").alias("n_removed"), kinds.alias("kinds"), report.bytes_removed().alias("bytes_removed"), "output_len")


def _pngs(spark, sf_dir: str) -> DataFrame:
    """Documents as PNG files: the text in a comment, 0 to 3 unknown chunks of 5 bytes by the id, a tail behind every second."""
    own = build.png_chunk(b"prVt", build.lit(b"owned"))
    more = F.unhex(F.repeat(F.hex(own), F.pmod("doc_id", F.lit(4)).cast("int")))
    tail = F.when(F.pmod("doc_id", F.lit(2)) == 1, build.lit(b"tail")).otherwise(build.lit(b""))
    return docs(spark, sf_dir, build.png_with(F.concat(build.png_chunk(b"tEXt", build.text_bytes()), more), tail))


_MORE = "(doc_id % 4)"


@query(expected("PNG", "complete", f"1 + {_MORE} + doc_id % 2", f"'comment' || repeat(',unrecognised structure', CAST({_MORE} AS INTEGER)) || CASE WHEN doc_id % 2 = 1 THEN ',trailing data' ELSE '' END", f"{LEN} + 5 * {_MORE} + 4 * (doc_id % 2)", str(len(build.BARE_PNG))))
def png_segments_native(spark, sf_dir):
    """The PNG scrub as one native projection."""
    return _facts(_pngs(spark, sf_dir), "PNG")


@query(expected("WebP", "complete", "2 + doc_id % 3", "'XMP' || repeat(',unrecognised structure', CAST(1 + doc_id % 3 AS INTEGER))", f"2 * {LEN} + 4 * (doc_id % 3)", "CASE WHEN doc_id % 3 = 0 THEN 24 ELSE 48 END"))
def webp_segments_native(spark, sf_dir):
    """WebP files, two in three with an animation frame that hides one or two chunks of its own."""
    hidden = lambda n: build.riff_chunk(b"ANMF", build.lit(bytes(16) + b"HIDE\4\0\0\0abcd" * n))
    frame = F.when(F.pmod("doc_id", F.lit(3)) == 0, build.lit(b"")).when(F.pmod("doc_id", F.lit(3)) == 1, hidden(1)).otherwise(hidden(2))
    return _facts(docs(spark, sf_dir, build.webp_with(F.concat(build.riff_chunk(b"XMP ", build.text_bytes()), build.riff_chunk(b"note", build.text_bytes()), frame))), "WebP")


@query(f"""SELECT type, kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
  SELECT 'tEXt' AS type, 'comment' AS kind, 1 AS n, {LEN} AS bytes FROM documents UNION ALL SELECT 'prVt', 'unrecognised structure', {_MORE}, 5 * {_MORE} FROM documents) GROUP BY ALL HAVING sum(n) > 0""")
def segments_dropped_by_type(spark, sf_dir):
    """Segment tables against the keep-list and the classes: an anti join and a left join."""
    gone = segments.dropped(segments.segment_table(_pngs(spark, sf_dir), ["doc_id"], "PNG"), "PNG")
    return gone.groupBy("type", "kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query(f"""SELECT marker, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
  SELECT 'FFD8' AS marker, 1 AS n, 0 AS bytes FROM documents UNION ALL SELECT 'FFE0', 1, 14 FROM documents UNION ALL SELECT 'FFDB', 1, 65 FROM documents UNION ALL SELECT 'FFDA', 1, 6 FROM documents UNION ALL
  SELECT 'FFFE', ({LEN} + 65532) // 65533, {LEN} FROM documents) GROUP BY marker HAVING sum(n) > 0""")
def jpeg_header_segments(spark, sf_dir):
    """The headers of JPEG files by marker; the scan data behind them is not walked."""
    walked = segments.segment_table(docs(spark, sf_dir, build.jpeg_with_comments(build.text_bytes())), ["doc_id"], "JPEG")
    return walked.groupBy(F.col("type").alias("marker")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


# --- ranges --------------------------------------------------------------------------------------


@query("""
WITH z AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_suppkey % 20 END AS file, l_orderkey * 8 + l_linenumber AS s, l_orderkey * 8 + l_linenumber + CAST(l_quantity AS BIGINT) % 9 AS e FROM lineitem),
p AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 20 END AS file, o_orderkey * 8 AS s, o_orderkey * 8 + CASE WHEN o_orderkey % 500 = 0 THEN 4000 ELSE o_custkey % 12 END AS e FROM orders)
SELECT file, count(*) AS ranges, CAST(sum(e - s) AS BIGINT) AS bytes FROM z WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.file = z.file AND z.s < p.e AND p.s < z.e AND z.s < z.e AND p.s < p.e) GROUP BY file""")
def ranges_outside_protected(spark, sf_dir):
    """Ranges to zero that touch no protected range of their file; a third of all lie in one file, some protected ranges reach over hundreds of orders."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    file = lambda key, by: F.when(F.pmod(key, F.lit(3)) == 0, F.lit(0).cast("long")).otherwise(F.pmod(by, F.lit(20)))
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    zero = lines.select(file(F.col("l_partkey"), F.col("l_suppkey")).alias("file"), at.alias("start"), (at + F.pmod(F.col("l_quantity").cast("long"), F.lit(9))).alias("end"))
    reach = F.when(F.pmod("o_orderkey", F.lit(500)) == 0, 4000).otherwise(F.pmod("o_custkey", F.lit(12)))
    kept = orders.select(file(F.col("o_orderkey"), F.col("o_custkey")).alias("file"), (F.col("o_orderkey") * 8).alias("start"), (F.col("o_orderkey") * 8 + reach).alias("end"))
    free = intervals.overlap_anti_join(zero, kept, ["file"], ["file", "start", "end"])  # rows with one file and range fare alike
    return free.groupBy("file").agg(F.count("*").alias("ranges"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


# --- elements ------------------------------------------------------------------------------------

_NO_NAV = "regexp_replace(html, '<nav[^>]*>(.|\\n)*?</nav>', '', 'g')"


@query(f"""SELECT page_id, CAST(CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS removed,
  md5(CASE page_id % 3 WHEN 0 THEN {_NO_NAV} WHEN 1 THEN 'tail' ELSE '</nav>' || {_NO_NAV} END) AS cleaned FROM pages""")
def elements_removed(spark, sf_dir):
    """Pages without their navigation; a third of them stands in a navigation of its own, a third begins with an end that nothing opened."""
    case, html = F.pmod("page_id", F.lit(3)), F.col("html")
    made = F.when(case == 0, html).when(case == 1, F.concat(F.lit("<x:NAV id='>'>"), html, F.lit("</nav><nav/>tail"))).otherwise(F.concat(F.lit("</nav>"), html))
    pages = table(spark, sf_dir, "pages").select("page_id", made.alias("html"))
    return elements.without_elements(pages, "html", ["page_id"], ["nav"]).select("page_id", "removed", F.md5("cleaned").alias("cleaned"))


@query(r"""SELECT page_id, name, parent, CAST(level AS INTEGER) AS level, CAST(n AS BIGINT) AS n FROM (
  SELECT page_id, unnest(['nav', 'ul', 'li', 'a']) AS name, unnest(['body', 'nav', 'ul', 'li']) AS parent, unnest([3, 4, 5, 6]) AS level,
         unnest([len(regexp_extract_all(html, '<nav>')), len(regexp_extract_all(html, '<ul>')), len(regexp_extract_all(html, '<li>')), len(regexp_extract_all(html, '<a '))]) AS n FROM pages)""")
def element_tree(spark, sf_dir):
    """Elements of the navigation with the names of their parents and their depth."""
    pages = table(spark, sf_dir, "pages").select("page_id", text.strip_scripts(F.col("html")).alias("html"))
    found = elements.elements(elements.tokens(pages, "html", ["page_id"], elements.VOID), ["page_id"])
    above = found.select("page_id", F.col("ord").alias("parent"), F.col("name").alias("parent_name"))
    joined = found.filter(F.col("name").isin("nav", "ul", "li", "a")).join(above, ["page_id", "parent"])
    return joined.groupBy("page_id", "name", F.col("parent_name").alias("parent"), "level").agg(F.count("*").alias("n"))


# --- references ----------------------------------------------------------------------------------

_LINKS = """links AS (
  SELECT o_custkey % 5 AS file, o_orderkey AS a, o_orderkey + 5 AS b FROM orders WHERE o_orderkey % 1000 < 700 UNION ALL
  SELECT o_custkey % 5, o_orderkey, o_orderkey * 2 FROM orders UNION ALL SELECT o_custkey % 5, o_orderkey, o_orderkey - 35 FROM orders WHERE o_orderkey % 7 = 0)"""


@query(f"""WITH RECURSIVE {_LINKS}, reached AS (
  SELECT o_custkey % 5 AS file, o_orderkey AS node FROM orders WHERE o_orderkey % 997 = 3 UNION SELECT l.file, l.b FROM reached r JOIN links l ON l.file = r.file AND l.a = r.node)
SELECT o_custkey % 5 AS file, count(*) AS objects, count(r.node) AS reached FROM orders o LEFT JOIN reached r ON r.file = o.o_custkey % 5 AND r.node = o.o_orderkey GROUP BY 1""")
def objects_reached(spark, sf_dir):
    """Orders as objects of five files that refer to each other, with long chains and rings; what each file's roots reach."""
    o = table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(5)).alias("file"), F.col("o_orderkey").alias("node"))
    n = F.col("node")
    to = F.array_compact(F.array(F.when(F.pmod(n, F.lit(1000)) < 700, n + 5), n * 2, F.when(F.pmod(n, F.lit(7)) == 0, n - 35)))
    seen = reachability.reachable(o.filter("node % 997 = 3"), o.select("file", "node", F.explode(to).alias("to"))).withColumn("seen", F.lit(1))
    return o.join(seen, ["file", "node"], "left").groupBy("file").agg(F.count("*").alias("objects"), F.count("seen").alias("reached"))


@query("SELECT doc_id, CAST(1 + CASE WHEN doc_id % 2 = 1 THEN doc_id % 7 ELSE 0 END AS BIGINT) AS orphans, CAST(4 + doc_id % 7 AS BIGINT) AS objects FROM documents")
def pdf_orphans(spark, sf_dir):
    """PDF files with 0 to 6 more objects in a chain, which hangs on the page of every second file: what the catalog does not reach."""
    n = F.pmod("doc_id", F.lit(7)).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    chain = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("\n"), (i + 9).cast("string"), F.lit(" 0 obj\n<</Next "), (i + 10).cast("string"), F.lit(" 0 R>>\nendobj"))), "")
    page = F.when(F.pmod("doc_id", F.lit(2)) == 0, "/Contents 10 0 R").otherwise("")
    whole = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]>>\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R"), page, F.lit(">>\nendobj"), chain,
        F.lit("\n4 0 obj\n<</Author<"), F.hex(build.text_bytes()), F.lit(">>>\nendobj\ntrailer\n<</Root 1 0 R/Info 4 0 R>>\n"),
    )
    files = docs(spark, sf_dir, F.encode(whole, "UTF-8"))
    objects, roots = reachability.pdf_graph(files, "doc_id")
    gone = reachability.orphans(objects, roots, reachability.pdf_references(objects)).select("file", "node", F.lit(1).alias("gone"))
    both = objects.select("file", "node").join(gone, ["file", "node"], "left").groupBy(F.col("file").alias("doc_id"))
    return both.agg(F.count("gone").alias("orphans"), F.count("*").alias("objects"))


# --- archives ------------------------------------------------------------------------------------


def _core(col: str) -> str:
    return f"'<cp:coreProperties><dc:creator>' || replace(replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</dc:creator></cp:coreProperties>'"


@query(f"""SELECT doc_id, CAST(ord AS INTEGER) AS ord, member, md5(data) AS data FROM (
  SELECT doc_id, unnest([0, 1, 2]) AS ord, unnest(['[Content_Types].xml', 'docProps/core.xml', 'word/document.xml']) AS member,
         unnest(['<Types/>', {_core("coalesce(text, '')")}, '<w:document><w:p/></w:document>']) AS data FROM documents)""")
def published_archives(spark, sf_dir):
    """Documents as office archives, put below a folder by the two-phase sink and read again member by member by byte ranges."""
    target = f"{scratch.folder(spark)}/published-{uuid.uuid4().hex[:12]}"
    made = docs(spark, sf_dir, build.docx_with(F.coalesce("text", F.lit(""))))
    name = F.concat(F.pmod("doc_id", F.lit(50)).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".docx"))
    published.publish(made.select(name.alias("path"), F.col("content").alias("data")), target)
    found = archives.read_archives(spark, target)
    return found.select(F.regexp_extract("archive", r"/(\d+)\.docx$", 1).cast("long").alias("doc_id"), "ord", "member", F.md5("data").alias("data"))


@query(f"""SELECT doc_id, CAST(n AS INTEGER) AS ord, member, md5(data) AS data FROM (
  SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN [0, 1] ELSE [0, 1, 2] END) AS n, unnest(CASE WHEN doc_id % 3 = 0 THEN ['[Content_Types].xml', 'word/document.xml'] ELSE ['[Content_Types].xml', 'docProps/core.xml', 'word/document.xml'] END) AS member,
         unnest(CASE doc_id % 3 WHEN 0 THEN ['<Types/>', '<w:document><w:p/></w:document>'] WHEN 1 THEN ['<Types/>', 'core of ' || doc_id, '<w:document><w:p/></w:document>']
                ELSE ['<Types/>', {_core("coalesce(text, '')")}, '<w:document><w:p/></w:document>'] END) AS data FROM documents)""")
def parts_edited(spark, sf_dir):
    """Office archives cut into parts, whose properties are dropped, replaced or left by the id, and put together again; read back from the new archives."""
    files = docs(spark, sf_dir, build.docx_with(F.coalesce("text", F.lit(""))))
    new = F.when(F.pmod("doc_id", F.lit(3)) == 1, F.encode(F.concat(F.lit("core of "), F.col("doc_id").cast("string")), "UTF-8"))
    edits = table(spark, sf_dir, "documents").filter("doc_id % 3 < 2").select("doc_id", F.lit("docProps/core.xml").alias("name"), new.alias("data"))
    again = repack.repacked(repack.edited(repack.parts(files, ["doc_id"]), edits, ["doc_id", "name"]), ["doc_id"])
    return repack.parts(again, ["doc_id"]).select("doc_id", "ord", F.col("name").alias("member"), F.md5("packed").alias("data"))


# --- rules and policies --------------------------------------------------------------------------


@query("""WITH rules AS (SELECT lower(substr(p_name, 1, 1 + p_partkey % 9)) AS prefix, min(p_partkey) AS ord FROM part WHERE p_partkey % 7 = 0 GROUP BY 1)
SELECT p_partkey, CAST(min(r.ord) AS BIGINT) AS rule FROM part LEFT JOIN rules r ON starts_with(lower(p_name), r.prefix) GROUP BY p_partkey""")
def first_rule_by_prefix(spark, sf_dir):
    """Names against ordered prefix rules taken from some of them: the first rule of each."""
    part = table(spark, sf_dir, "part")
    rules = part.filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("ord"), F.substring(F.col("p_name"), F.lit(1), (1 + F.pmod("p_partkey", F.lit(9))).cast("int")).alias("prefix"), F.col("p_partkey").alias("rule"))
    return lookup.first_by_prefix(part.select("p_partkey", F.upper("p_name").alias("name")), ["p_partkey"], "name", rules, "rule")


@query("SELECT doc_id, CAST(1 + doc_id % 5 AS BIGINT) AS generation, strlen(coalesce(text, '')) AS bytes FROM documents")
def newest_policy_results(spark, sf_dir):
    """Documents that arrive as results of up to five policies in mixed order: the newest one's result of each."""
    path = f"{sf_dir}/documents.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/documents.parque[t]")
    n = 1 + F.pmod("doc_id", F.lit(5))
    results = rows.select("doc_id", F.explode(F.shuffle(F.sequence(F.lit(1).cast("long"), n), seed=7)).alias("generation"), F.timestamp_seconds(F.col("doc_id") + 1).alias("modificationTime"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return run_available(newest_policy(results, path="doc_id")).select("doc_id", "generation", "bytes")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'GIF' WHEN 1 THEN 'AVIF' WHEN 2 THEN 'TIFF' ELSE CASE WHEN starts_with(html, 'RIFF') THEN NULL ELSE 'unknown format' END END AS format FROM pages")
def detect_in_sql(spark, sf_dir):
    """Detection asked for in SQL: pages behind heads that leading bytes settle, and others that are probed."""
    register(spark)
    heads = [build.lit(b"GIF89a"), build.lit(b"\0\0\0\x18ftypavif\0\0\0\0mif1avif"), build.lit(b"II*\0\x08\0\0\0\0\0\0\0\0\0"), build.lit(b"")]
    head = F.element_at(F.array(*heads), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.encode("html", "UTF-8")).alias("content")).createOrReplaceTempView("tw_pages")
    return spark.sql("SELECT page_id, tw_detect_format(content) AS format FROM tw_pages")


# --- tiles ---------------------------------------------------------------------------------------

_AT = "list_avg(list_transform(range(25), lambda k: e[1 + 8 * greatest(0, least(h - 1, i // 8 - 2 + k // 5)) + greatest(0, least(7, i % 8 - 2 + k % 5))]))"


@query(f"""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) // 8 AS h FROM embeddings)
SELECT vec_id, CAST(i AS INTEGER) AS i, round({_AT}, 6) + 0.0 AS value FROM (SELECT vec_id, e, h, unnest(range(8 * h)) AS i FROM p)""")
def tiled_blur(spark, sf_dir):
    """Embeddings as pictures eight samples wide, blurred over boxes of five by tiles of three."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.size("embedding") / 8).cast("int").alias("height"), F.posexplode("embedding").alias("i", "value"))
    samples = v.filter(F.col("i") < 8 * F.col("height")).select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.lit(8).alias("width"), "height", "value")
    return tiles.box_blur(samples, ["vec_id"], 2, 3).select("vec_id", (8 * F.col("y") + F.col("x")).alias("i"), (F.round("value", 6) + F.lit(0.0)).alias("value"))
