"""Containers as tables of segments, walked by folds inside one expression.

A container's segments follow each other: each says where the next one starts. ``walk`` carries that
place as the state of a fold and gives the segments as an array of (type, start, body, length), so a
scan, the walk and everything after it stay in one native plan: no Python worker, and no bytes copied
until an output is asked for. Keep-lists and classes are tables of their own and meet the exploded
segments by semi, anti and left joins; both are fixed and of a few dozen rows.

PNG and WebP are scrubbed as the per-file grammar does (same report rows, same bytes, same class of
error); JPEG headers and ISO media boxes are walked for analysis.

Defined results: null content is an error row of class ``io``, as in ``scrub``; a file that is cut short or does not
start with its signature has class ``malformed`` and no segments in the table; a file without anything
to drop is rebuilt all the same. A walk takes as many steps as the file has segments, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import big_endian, little_endian, part
from .formats import png, webp
from .formats.exif import DEPTH, SUB_DIRECTORIES
from .formats.jpeg import EOI, SOI, STRUCTURAL
from .model import COMPLETE, MAKER_NOTE, THUMBNAIL, TRAILER, UNKNOWN, Policy

FAN = 64
SEGMENT = "struct<type: string, start: bigint, body: bigint, length: bigint>"
_FOUND = f"array<{SEGMENT}>"
_STEP = "struct<type: string, body: bigint, length: bigint, next: bigint, last: boolean, error: string>"
FORMATS = ("PNG", "WebP", "JPEG", "ISO media")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(state: Column, most: Column, step: Callable[[Column], Column], over: Callable[[Column], Column]) -> Column:
    """``step`` applied to ``state`` until ``over`` holds, ``most`` times at most; idle rounds are skipped ``FAN`` at a time."""

    def some(s: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(FAN)), s, lambda x, _: F.when(over(x), x).otherwise(step(x)))

    rounds = F.greatest(F.ceil(most / FAN), F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), rounds), state, lambda s, _: F.when(over(s), s).otherwise(some(s)))


def tag(content: Column, at: Column, n: int = 4) -> Column:
    return F.decode(part(content, at, n), "ISO-8859-1")


def printable(tag: Column) -> Column:
    """A segment's type for a report; bytes that do not print as \\xNN."""
    one = F.transform(F.split(tag, ""), lambda c: F.when((c >= " ") & (c <= "~"), c).otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.encode(c, "ISO-8859-1")), 2, "0")))))
    return F.when(tag.rlike("^[ -~]*$"), tag).otherwise(F.array_join(one, ""))


def walk(content: Column, start: int | Column, end: Column, least: int, step: Callable[[Column], Column]) -> Column:
    """struct(found, at, error) of the segments from ``start`` on.

    ``step`` gives, for a place, struct(type, body, length, next, last, error); a segment takes ``least``
    bytes or more. The walk ends at ``end``, after a last segment or with an error.
    """
    first = (F.lit(start) if isinstance(start, int) else start).cast("bigint")

    def state(at: Column, over: Column, error: Column, r: Column, found: Column) -> Column:
        return F.struct(at.alias("at"), over.alias("over"), error.cast("string").alias("error"), r.cast(_STEP).alias("r"), found.alias("found"))

    def moved(s: Column) -> Column:
        r, bad = s["r"], s["r"]["error"].isNotNull()
        segment = F.struct(r["type"].alias("type"), s["at"].alias("start"), r["body"].alias("body"), r["length"].alias("length"))
        ends = bad | r["last"] | (r["next"] >= end)
        return state(F.when(bad, s["at"]).otherwise(r["next"]), ends, r["error"], F.when(~ends, step(r["next"])), F.when(bad, s["found"]).otherwise(F.array_append(s["found"], segment)))

    def some(s: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(FAN)), s, lambda x, _: F.when(x["over"], x).otherwise(moved(x)))

    def gathered(run: Callable[[Column], Column], rounds: Column) -> Callable[[Column], Column]:
        """``run`` some rounds long. A fold copies its state each round, so what earlier rounds found is kept out of the inner one's."""

        def all_rounds(s: Column) -> Column:
            fresh = lambda x: state(x["at"], x["over"], x["error"], x["r"], F.array().cast(_FOUND))
            begun = F.struct(s.alias("now"), F.array().cast(f"array<{_FOUND}>").alias("blocks"))
            more = lambda o: F.struct(run(fresh(o["now"])).alias("now"), F.array_append(o["blocks"], o["now"]["found"]).alias("blocks"))
            whole = lambda o: state(o["now"]["at"], o["now"]["over"], o["now"]["error"], o["now"]["r"], F.flatten(F.array_append(o["blocks"], o["now"]["found"])))
            return F.aggregate(F.sequence(F.lit(1), rounds), begun, lambda o, _: F.when(o["now"]["over"], o).otherwise(more(o)), whole)

        return all_rounds

    most = F.greatest(F.ceil((end - first) / (least * FAN * FAN)), F.lit(0)).cast("int") + 1
    begun = state(first, first >= end, F.lit(None), F.when(first < end, step(first)), F.array().cast(_FOUND))
    return gathered(gathered(some, F.lit(FAN)), most)(begun)


def _step(type: Column, body: Column, length: Column, next: Column, last: Column | bool, error: Column) -> Column:
    ends = F.lit(last) if isinstance(last, bool) else F.coalesce(last, F.lit(False))
    return F.struct(type.alias("type"), body.cast("bigint").alias("body"), length.cast("bigint").alias("length"), next.cast("bigint").alias("next"), ends.alias("last"), error.cast("string").alias("error"))


def _png(content: Column) -> Column:
    size = F.length(content)

    def step(at: Column) -> Column:
        def read(r: Column) -> Column:
            n = r["n"]
            error = (
                F.when(n.isNull(), "a chunk's length is cut short").when(n > png.MOST, "a chunk is beyond the limit").when(r["t"].isNull(), "a chunk's type is cut short")
                .when(at + 12 + n > size, "a chunk is cut short")
            )
            return _step(r["t"], at + 8, n, at + 12 + n, r["t"] == "IEND", error)

        return let(F.struct(big_endian(content, at, 4).alias("n"), tag(content, at + 4).alias("t")), read)

    ended = lambda s: F.element_at(s["found"], -1)["type"]
    walked = walk(content, 8, size, 12, step)
    error = lambda s: F.when(~F.startswith(content, F.lit(png.MAGIC)), "the signature is missing").otherwise(F.coalesce(s["error"], F.when((F.size(s["found"]) == 0) | (ended(s) != "IEND"), "there is no IEND chunk")))
    return let(walked, lambda s: F.struct(s["found"].alias("found"), s["at"].alias("at"), F.when(F.size(s["found"]) == 0, F.coalesce(s["error"], F.lit("there is no IEND chunk"))).otherwise(error(s)).alias("error")))


def _riff(content: Column, start: int | Column, end: Column, strict: bool) -> Column:
    """RIFF chunks; where not ``strict``, the walk stops before a chunk that is cut short."""

    def step(at: Column) -> Column:
        def read(r: Column) -> Column:
            n = r["n"]
            cut = r["t"].isNull() | n.isNull() | (at + 8 + n > (F.length(content) if strict else end))
            return _step(r["t"], at + 8, n, at + 8 + n + n % 2, False, F.when(cut, "a chunk is cut short"))

        return let(F.struct(little_endian(content, at + 4, 4).alias("n"), tag(content, at).alias("t")), read)

    return walk(content, start, end, 8, step)


def _webp_end(content: Column) -> Column:
    return F.least(F.length(content), 8 + little_endian(content, 4, 4))


def _webp(content: Column) -> Column:
    sound = F.startswith(content, F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    walked = _riff(content, 12, F.coalesce(_webp_end(content), F.lit(0)), True)
    error = lambda s: F.when(~sound, "the RIFF header is missing").otherwise(s["error"])
    return let(walked, lambda s: F.struct(s["found"].alias("found"), s["at"].alias("at"), error(s).alias("error")))


def _jpeg(content: Column) -> Column:
    """Header segments up to and with the first scan's; markers without a length stand alone."""
    size = F.length(content)

    def step(at: Column) -> Column:
        def read(r: Column) -> Column:
            bare = r["m"].isin("FF01", "FFD8", "FFD9") | r["m"].between("FFD0", "FFD7")
            n = F.when(bare, 0).otherwise(r["n"] - 2)
            error = F.when(r["m"].isNull() | ~F.startswith(r["m"], F.lit("FF")), "a marker is missing").when(n.isNull() | (n < 0) | (at + F.when(bare, 2).otherwise(4) + n > size), "a segment is cut short")
            body = at + F.when(bare, 2).otherwise(4)
            return F.when(r["m"] == "FFFF", _step(F.lit("FILL"), at + 1, F.lit(0).cast("bigint"), at + 1, False, F.lit(None).cast("string"))).otherwise(_step(r["m"], body, n.cast("bigint"), body + n, r["m"].isin("FFDA", "FFD9"), error))

        return let(F.struct(F.hex(part(content, at, 2)).alias("m"), big_endian(content, at + 2, 2).alias("n")), read)

    return walk(content, 0, size, 2, step)


def _boxes(content: Column) -> Column:
    """Top-level boxes of an ISO media file; size 0 reaches to the end, size 1 takes 64 bits (56 of them here)."""
    size = F.length(content)

    def step(at: Column) -> Column:
        def read(r: Column) -> Column:
            head = F.when(r["n"] == 1, 16).otherwise(8)
            n = F.when(r["n"] == 1, r["wide"]).when(r["n"] == 0, size - at).otherwise(r["n"]) - head
            return _step(r["t"], at + head, n, at + head + n, r["n"] == 0, F.when(r["t"].isNull() | n.isNull() | (n < 0) | (at + head + n > size), "a box is cut short"))

        return let(F.struct(big_endian(content, at, 4).alias("n"), tag(content, at + 4).alias("t"), big_endian(content, at + 9, 7).alias("wide")), read)

    return walk(content, 0, size, 8, step)


_WALKS = {"PNG": _png, "WebP": _webp, "JPEG": _jpeg, "ISO media": _boxes}


def segments(content: Column, format: str) -> Column:
    """struct(found, at, error): the segments of a file, the place after the last, what is wrong with it."""
    return _WALKS[format](F.coalesce(content, F.lit(b"")))


# --- tables --------------------------------------------------------------------------------------


def segment_table(files: DataFrame, keep: list[str], format: str) -> DataFrame:
    """``keep`` columns, ord, type, start, body, length: a row for each segment, the bytes left behind."""
    walked = files.select(*keep, segments(F.col("content"), format).alias("_walk"))
    # no filter on the error, which would be pushed below and walk twice
    return walked.select(*keep, F.posexplode(F.when(F.col("_walk.error").isNull(), F.col("_walk.found"))).alias("ord", "_segment")).select(*keep, "ord", "_segment.type", "_segment.start", "_segment.body", "_segment.length")


def keep_list(spark: SparkSession, format: str, policy: Policy = Policy()) -> DataFrame:
    """(type) of the segments that stay; a fixed table."""
    if format == "PNG":
        kept = sorted(t.decode() for t in png.KEEP) + (["iCCP"] if policy.keep_profile else [])
    elif format == "WebP":
        kept = sorted(t.decode() for t in webp.KEEP) + (["ICCP"] if policy.keep_profile else [])
    else:
        kept = sorted(f"FF{m:02X}" for m in (SOI, EOI, *STRUCTURAL))
    return spark.createDataFrame([(t,) for t in kept], "type string")


def classes(spark: SparkSession, format: str) -> DataFrame:
    """(type, kind) of the segments that have a name of their own; a fixed table."""
    named = {t.decode(): k for t, k in png.KIND.items()} if format == "PNG" else {t.decode(): k for t, (k, _) in webp.KIND.items()}
    return spark.createDataFrame(sorted(named.items()), "type string, kind string")


def dropped(table: DataFrame, format: str, policy: Policy = Policy()) -> DataFrame:
    """The segments that go, with their ``kind``: an anti join with the keep-list, a left join with the classes."""
    spark = table.sparkSession
    gone = table.join(F.broadcast(keep_list(spark, format, policy)), "type", "left_anti")
    named = gone.join(F.broadcast(classes(spark, format)), "type", "left")
    return named.withColumn("kind", F.coalesce("kind", F.lit(UNKNOWN)))


def kept(table: DataFrame, format: str, policy: Policy = Policy()) -> DataFrame:
    return table.join(F.broadcast(keep_list(table.sparkSession, format, policy)), "type", "left_semi")


# --- EXIF ----------------------------------------------------------------------------------------


def exif_facts(block: Column) -> Column:
    """struct(gps, maker_note, thumbnail) of an EXIF block: its directories visited once each, by a fold over what is still to do."""
    little = F.startswith(block, F.lit(b"II"))

    def number(at: Column, n: int) -> Column:
        """An unsigned integer in the block's order; null where it is not whole."""
        turned = lambda h: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])
        return let(F.hex(F.substring(block, (F.least(at, F.lit(2**31 - 2)) + 1).cast("int"), F.lit(n))), lambda h: F.when((at >= 0) & (F.length(h) == 2 * n), F.conv(F.when(little, turned(h)).otherwise(h), 16, 10).cast("long")))

    sound = (little | F.startswith(block, F.lit(b"MM"))) & (number(F.lit(2), 2) == 42)
    first = number(F.lit(4), 4)
    place = "struct<at: bigint, depth: int>"
    state = F.struct(
        F.array(F.struct(F.coalesce(first, F.lit(-1)).alias("at"), F.lit(0).alias("depth"))).cast(f"array<{place}>").alias("todo"), F.array().cast("array<bigint>").alias("seen"), F.lit(False).alias("gps"), F.lit(False).alias("maker")
    )

    def visit(s: Column) -> Column:
        def read(r: Column) -> Column:
            at, depth, rest = r["at"], r["depth"], F.slice(s["todo"], 1, F.size(s["todo"]) - 1)
            skip = F.array_contains(s["seen"], at) | (depth > DEPTH) | (at < 0)
            n = F.least(F.coalesce(number(at, 2), F.lit(0)), F.floor((F.length(block) - at) / 12 + 1))
            at_entry = F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: at + 2 + 12 * i)
            found = F.transform(at_entry, lambda p: F.struct(F.when(number(p + 4, 4).isNotNull(), number(p, 2)).alias("tag"), number(p + 8, 4).alias("value")))

            def after(e: Column) -> Column:
                subs = F.transform(F.filter(e, lambda x: x["tag"].isin(*SUB_DIRECTORIES) & x["value"].isNotNull()), lambda x: F.struct(x["value"].alias("at"), (depth + 1).alias("depth")))
                return F.struct(
                    F.concat(rest, subs).cast(f"array<{place}>").alias("todo"), F.array_append(s["seen"], at).alias("seen"), (s["gps"] | F.exists(e, lambda x: F.coalesce(x["tag"].isin(2, 4), F.lit(False)))).alias("gps"),
                    (s["maker"] | F.exists(e, lambda x: F.coalesce(x["tag"] == 0x927C, F.lit(False)))).alias("maker"),
                )

            return F.when(skip, F.struct(rest.alias("todo"), s["seen"].alias("seen"), s["gps"].alias("gps"), s["maker"].alias("maker"))).otherwise(let(found, after))

        return let(F.element_at(s["todo"], -1), read)

    done = fold(state, F.length(block) / 6 + 1, visit, lambda s: F.size(s["todo"]) == 0)
    entries = number(first, 2)
    thumbnail = F.coalesce(number(first + 2 + 12 * entries, 4) != 0, F.lit(False))
    none = F.struct(F.lit(False).alias("gps"), F.lit(False).alias("maker_note"), F.lit(False).alias("thumbnail"))
    return F.when(F.coalesce(sound, F.lit(False)), let(done, lambda s: F.struct(s["gps"].alias("gps"), s["maker"].alias("maker_note"), thumbnail.alias("thumbnail")))).otherwise(none)


# --- scrubbing -----------------------------------------------------------------------------------


def _bytes(content: Column, at: Column, n: Column) -> Column:
    return F.substring(content, (at + 1).cast("int"), n.cast("int"))


def _le(n: Column) -> Column:
    """Four little-endian bytes, as hexadecimal."""
    h = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def _row(kind: Column | str, location: Column | str, size: Column) -> Column:
    k, w = (F.lit(x) if isinstance(x, str) else x for x in (kind, location))
    return F.struct(k.alias("kind"), w.alias("location"), size.cast("bigint").alias("bytes"))


_ROW = "array<struct<kind: string, location: string, bytes: bigint>>"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def _facts_of(content: Column, found: Column, type: str) -> Column:
    """The facts of each EXIF segment with its start."""
    mine = F.filter(found, lambda x: x["type"] == type)
    return F.transform(mine, lambda x: F.struct(x["start"].alias("start"), exif_facts(_bytes(content, x["body"], x["length"])).alias("facts")))


def _scrub_png(content: Column, walked: Column, exif: Column, policy: Policy) -> tuple[Column, Column, Column, Column]:
    """(removed, found_location, error, output as hexadecimal)"""
    keep = F.array(*[F.lit(t.decode()) for t in (*sorted(png.KEEP), *((b"iCCP",) if policy.keep_profile else ()))])
    found, kinds = walked["found"], _map({t.decode(): k for t, k in png.KIND.items()})
    stays = lambda x: F.array_contains(keep, x["type"])
    bad = F.exists(found, lambda x: stays(x) & (F.crc32(_bytes(content, x["start"] + 4, x["length"] + 4)) != big_endian(content, x["body"] + x["length"], 4)))
    gone = F.filter(found, lambda x: ~stays(x))

    def rows(x: Column) -> Column:
        own = F.array(_row(F.coalesce(F.try_element_at(kinds, x["type"]), F.lit(UNKNOWN)), printable(x["type"]), x["length"]))
        noted = F.filter(exif, lambda e: (e["start"] == x["start"]) & e["facts"]["maker_note"])
        return F.concat(own, F.transform(noted, lambda _: _row(MAKER_NOTE, "eXIf maker note", F.lit(0))))

    rest = F.length(content) - walked["at"]
    trailer = F.when(rest > 0, F.array(_row(TRAILER, "after IEND", rest))).otherwise(F.array().cast(_ROW))
    removed = F.concat(F.flatten(F.transform(gone, rows)), trailer)
    location = F.exists(exif, lambda e: e["facts"]["gps"])
    out = F.concat(F.lit(png.MAGIC.hex()), F.array_join(F.transform(F.filter(found, stays), lambda x: F.hex(_bytes(content, x["start"], x["length"] + 12))), ""))
    return removed, location, F.when(bad, "a checksum is wrong"), out


def _chunk(tag_hex: Column | str, n: Column, body_hex: Column) -> Column:
    t = F.lit(tag_hex) if isinstance(tag_hex, str) else tag_hex
    return F.concat(t, _le(n), body_hex, F.when(n % 2 == 1, "00").otherwise(""))


def _scrub_webp(content: Column, walked: Column, exif: Column, policy: Policy) -> tuple[Column, Column, Column, Column]:
    keep = F.array(*[F.lit(t.decode()) for t in (*sorted(webp.KEEP), *((b"ICCP",) if policy.keep_profile else ()))])
    in_frame = F.array(*[F.lit(t.decode()) for t in sorted(webp.FRAME_KEEP)])
    kinds, places = _map({t.decode(): k for t, (k, _) in webp.KIND.items()}), _map({t.decode(): w for t, (_, w) in webp.KIND.items()})
    stays = lambda x: F.array_contains(keep, x["type"])
    frame = lambda x: (x["type"] == "ANMF") & (x["length"] >= webp.FRAME_HEADER)
    parts = lambda x: _riff(content, x["body"] + webp.FRAME_HEADER, x["body"] + x["length"], False)
    none = F.array().cast(_ROW)

    def within(x: Column, p: Column) -> Column:
        rows = F.transform(F.filter(p["found"], lambda y: ~F.array_contains(in_frame, y["type"])), lambda y: _row(UNKNOWN, F.concat(F.lit("ANMF/"), printable(y["type"])), y["length"]))
        rest = x["body"] + x["length"] - p["at"]
        return F.concat(rows, F.when(rest > 0, F.array(_row(UNKNOWN, "ANMF trailing bytes", rest))).otherwise(none))

    def of_exif(x: Column) -> Column:
        mine = F.filter(exif, lambda e: e["start"] == x["start"])
        note = F.transform(F.filter(mine, lambda e: e["facts"]["maker_note"]), lambda _: _row(MAKER_NOTE, "EXIF maker note", F.lit(0)))
        return F.concat(note, F.transform(F.filter(mine, lambda e: e["facts"]["thumbnail"]), lambda _: _row(THUMBNAIL, "EXIF IFD1", F.lit(0))))

    def rows(x: Column) -> Column:
        own = F.array(_row(F.coalesce(F.try_element_at(kinds, x["type"]), F.lit(UNKNOWN)), F.coalesce(F.try_element_at(places, x["type"]), printable(x["type"])), x["length"]))
        return F.when(frame(x), let(parts(x), lambda p: within(x, p))).when(stays(x), none).otherwise(F.concat(of_exif(x), own))

    def bytes_of(x: Column) -> Column:
        whole = F.hex(_bytes(content, x["body"], x["length"]))
        mask = 0xFF & ~(webp.FLAG_EXIF | webp.FLAG_XMP | (0 if policy.keep_profile else webp.FLAG_ICC))
        flags = F.lpad(F.hex(big_endian(content, x["body"], 1).bitwiseAND(F.lit(mask))), 2, "0")
        head = F.concat(flags, F.hex(_bytes(content, x["body"] + 1, F.least(x["length"], F.lit(webp.HEADER)) - 1)))

        def rebuilt(p: Column) -> Column:
            inner = F.transform(F.filter(p["found"], lambda y: F.array_contains(in_frame, y["type"])), lambda y: _chunk(F.hex(F.encode(y["type"], "ISO-8859-1")), y["length"], F.hex(_bytes(content, y["body"], y["length"]))))
            return F.concat(F.hex(_bytes(content, x["body"], F.lit(webp.FRAME_HEADER))), F.array_join(inner, ""))

        body = F.when((x["type"] == "VP8X") & (x["length"] > 0), head).when(frame(x), let(parts(x), rebuilt)).otherwise(whole)
        return let(body, lambda b: _chunk(F.hex(F.encode(x["type"], "ISO-8859-1")), (F.length(b) / 2).cast("bigint"), b))

    found = walked["found"]
    end = 8 + little_endian(content, 4, 4)
    trailer = F.when(end < F.length(content), F.array(_row(TRAILER, "after the RIFF payload", F.length(content) - end))).otherwise(none)
    removed = F.concat(trailer, F.flatten(F.transform(found, rows)))
    location = F.exists(exif, lambda e: e["facts"]["gps"])
    body = F.array_join(F.transform(F.filter(found, stays), bytes_of), "")
    out = let(body, lambda b: F.concat(F.lit(b"RIFF".hex()), _le(4 + (F.length(b) / 2).cast("bigint")), F.lit(b"WEBP".hex()), b))
    return removed, location, F.when(~F.exists(found, stays), "no image data"), out


_SCRUBS = {"PNG": (_scrub_png, "eXIf"), "WebP": (_scrub_webp, "EXIF")}


def scrub_native(files: DataFrame, keep: list[str], format: str, policy: Policy = Policy(), emit: bool = True) -> DataFrame:
    """``keep`` columns with the report of a PNG or WebP file, and ``data`` where asked; all in one native projection.

    The columns are format, assurance, found_location, input_len, output_len, removed, retained, error and data, as ``scrub`` gives them.
    """
    scrubbed, exif = _SCRUBS[format]
    removed, location, wrong, out = scrubbed(F.col("content"), F.col("_walk"), F.col("_exif"), policy)
    walked = files.select("content", *keep, segments(F.col("content"), format).alias("_walk"))
    walked = walked.withColumn("_exif", _facts_of(F.col("content"), F.col("_walk.found"), exif))
    sound = walked.withColumn("_error", F.coalesce(F.col("_walk.error"), F.when(F.col("_walk.error").isNull(), wrong)))
    ok = F.col("_error").isNull() & F.col("content").isNotNull()
    profile = F.exists("_walk.found", lambda x: F.lower(x["type"]) == "iccp") if policy.keep_profile else F.lit(False)
    kept_profile = F.array(F.struct(F.lit("ICC_PROFILE").alias("what"), F.lit("device, software and creation date of the colour profile").alias("reveals")))
    made = sound.select(
        *keep, F.lit(format).alias("format"), F.when(ok, F.lit(COMPLETE).cast("byte")).alias("assurance"), F.when(ok, location).alias("found_location"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("input_len"),
        F.when(ok, removed).otherwise(F.array().cast(_ROW)).alias("_removed"), F.when(ok & profile, kept_profile).otherwise(F.array().cast("array<struct<what: string, reveals: string>>")).alias("retained"),
        F.when(~ok, F.struct(F.when(F.col("content").isNull(), "io").otherwise("malformed").alias("class"), F.lit(format).alias("format"), F.coalesce("_error", F.lit("no content")).alias("detail"))).alias("error"),
        F.when(ok, F.unhex(out)).alias("data"),
    )
    numbered = F.transform("_removed", lambda x, i: F.struct(i.alias("ord"), x["kind"].alias("kind"), x["location"].alias("location"), x["bytes"].alias("bytes")))
    columns = [*keep, "format", "assurance", "found_location", "input_len", F.length("data").cast("long").alias("output_len"), numbered.alias("removed"), "retained", "error", *(["data"] if emit else [])]
    return made.select(*columns)
