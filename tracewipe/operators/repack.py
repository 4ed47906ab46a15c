"""Archives as tables of parts: split, edited by joins, put together again.

The central directory is walked by a fold, so the parts of an archive come as rows without a Python
worker: number, name, method, checksum, sizes and the packed bytes. Rows may then be joined with a table of
edits, filtered, or given new bytes; ``repacked`` lays local headers and the directory out again with
offsets from a running sum. Parts that no edit touched keep their packed bytes, so nothing is
decompressed; edited ones are stored. Headers are written anew: no times, extra fields or comments.

One archive is one group, as it is one row; members of many archives spread over the cluster.
Archives with ZIP64 records, encrypted members or a damaged directory have no parts here and are listed
by ``unreadable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import let, walk

_HEAD, _ENTRY, _END = b"PK\3\4", b"PK\1\2", b"PK\5\6"
#: Version needed, made by, and the first of January 1980.
_NEEDED, _MADE, _DATE = 20, 20, 0x0021


def _end(content: Column) -> Column:
    """Place of the end record: the last one that reaches to the end of the file."""
    tail = F.greatest(F.length(content) - 65_557, F.lit(0))
    hexed = F.hex(F.substring(content, tail + 1, F.lit(65_557)))
    # the last mark on a whole byte: marks on half bytes do not occur, as "504B0506" has no period
    at = F.length(hexed) - F.length(F.substring_index(hexed, _END.hex().upper(), -1)) - 8
    return F.when(F.contains(hexed, F.lit(_END.hex().upper())) & (at % 2 == 0), tail + (at / 2).cast("bigint"))


def _bytes(content: Column, at: Column, n: int) -> Column:
    """``n`` bytes as hexadecimal, fewer where the file ends."""
    return F.hex(F.substring(content, (F.least(at, F.lit(2**31 - 2)) + 1).cast("int"), F.lit(n)))


def _number(h: Column, at: int, n: int) -> Column:
    """A little-endian number at byte ``at`` of hexadecimal ``h``; null where it is not whole."""
    digits = F.concat(*[F.substring(h, 2 * (at + i) + 1, 2) for i in range(n - 1, -1, -1)])
    return F.when(F.length(digits) == 2 * n, F.conv(digits, 16, 10).cast("long"))


def _step(content: Column):
    """The entry of the central directory at a place: its name, its data's place and packed length."""

    def placed(r: Column) -> Column:
        # the name and extra field of the local header may differ from the entry's
        lengths = _bytes(content, r["offset"] + 26, 4)
        body = let(lengths, lambda h: r["offset"] + 30 + _number(h, 0, 2) + _number(h, 2, 2))

        def checked(x: Column) -> Column:
            bad = F.coalesce((r["mark"] != _ENTRY.hex().upper()) | (r["flags"] % 2 == 1) | (r["packed"] == 0xFFFFFFFF) | (x + r["packed"] > F.length(content)), F.lit(True))
            return F.struct(r["name"].alias("type"), x.alias("body"), r["packed"].alias("length"), r["next"].alias("next"), F.lit(False).alias("last"), F.when(bad, "malformed").alias("error"))

        return let(body, checked)

    def step(at: Column) -> Column:
        def entry(h: Column) -> Column:
            n = _number(h, 28, 2)
            return F.struct(
                F.substring(h, 1, 8).alias("mark"), _number(h, 8, 2).alias("flags"), _number(h, 20, 4).alias("packed"), _number(h, 42, 4).alias("offset"), (at + 46 + n + _number(h, 30, 2) + _number(h, 32, 2)).alias("next"),
                F.decode(F.substring(content, (at + 47).cast("int"), n.cast("int")), "UTF-8").alias("name"),
            )

        return let(let(_bytes(content, at, 46), entry), placed)

    return step


def _walked(files: DataFrame, id: list[str]) -> DataFrame:
    """``id``, content and ``_w``: the members of the central directory, or what is wrong with it."""
    content = F.col("content")
    rows = files.select(*id, F.coalesce("content", F.lit(b"")).alias("content"))
    rows = rows.withColumn("_end", _bytes(content, F.coalesce(_end(content), F.lit(2**31 - 2)), 22))
    rows = rows.withColumn("_start", _number(F.col("_end"), 16, 4)).withColumn("_stop", F.col("_start") + _number(F.col("_end"), 12, 4)).withColumn("_count", _number(F.col("_end"), 10, 2))
    rows = rows.withColumn("_w", walk(content, F.coalesce("_start", F.lit(0)), F.coalesce("_stop", F.lit(0)), 46, _step(content)))
    wrong = F.when(F.col("_start").isNull(), "malformed").when((F.col("_count") == 0xFFFF) | (F.col("_start") == 0xFFFFFFFF), "unsupported").otherwise(F.coalesce("_w.error", F.when(F.size("_w.found") != F.col("_count"), "malformed")))
    return rows.select(*id, "content", F.col("_w.found").alias("_found"), wrong.alias("error"))


def parts(files: DataFrame, id: list[str]) -> DataFrame:
    """``id``, ord, name, method, crc, size, packed: a row for each member of each readable archive."""
    # no filter on the error, which would be pushed below and walk twice
    rows = _walked(files, id).select(*id, "content", F.posexplode(F.when(F.col("error").isNull(), F.col("_found"))).alias("ord", "_p"))
    rows = rows.withColumn("_h", _bytes(F.col("content"), F.col("_p.start"), 28))  # the entry's own numbers
    h, data = F.col("_h"), F.substring("content", (F.col("_p.body") + 1).cast("int"), F.col("_p.length").cast("int"))
    return rows.select(*id, "ord", F.col("_p.type").alias("name"), _number(h, 10, 2).cast("int").alias("method"), _number(h, 16, 4).alias("crc"), _number(h, 24, 4).alias("size"), data.alias("packed"))


def unreadable(files: DataFrame, id: list[str]) -> DataFrame:
    """``id``, error of the files that have no parts here."""
    return _walked(files, id).filter("error is not null").select(*id, "error")


def edited(parts: DataFrame, edits: DataFrame, on: list[str]) -> DataFrame:
    """``parts`` with the bytes of ``edits`` (``on``, data) where there are some, and without those whose data is null.

    ``edits`` has one row for each ``on``; parts that none names stay as they are.
    """
    given = edits.select(*on, F.col("data").alias("_data"), F.lit(True).alias("_named"))
    met = parts.join(given, on, "left")
    new = F.col("_data").isNotNull()
    rows = met.filter("_named is null or _data is not null")
    values = {"method": F.lit(0), "crc": F.crc32("_data"), "size": F.length("_data").cast("long"), "packed": F.col("_data")}
    return rows.select(*[F.when(new, values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in parts.columns])


def _le(n: Column, width: int) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)]))


def repacked(parts: DataFrame, id: list[str]) -> DataFrame:
    """``id``, content: the archives of ``parts``, members in their order."""
    name = F.encode("name", "UTF-8")
    utf8 = F.when(F.length(name) != F.length("name"), 0x0800).otherwise(0)
    facts = F.concat(_le(utf8, 2), _le(F.col("method"), 2), F.lit(b"\0\0"), F.lit(_DATE.to_bytes(2, "little")), _le(F.col("crc"), 4), _le(F.length("packed"), 4), _le(F.col("size"), 4), _le(F.length(name), 2), F.lit(b"\0\0"))
    local = F.concat(F.lit(_HEAD + _NEEDED.to_bytes(2, "little")), facts, name, F.col("packed"))
    before = Window.partitionBy(*id).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_local", local).withColumn("_at", F.coalesce(F.sum(F.length("_local")).over(before), F.lit(0)))
    entry = F.concat(F.lit(_ENTRY + _MADE.to_bytes(2, "little") + _NEEDED.to_bytes(2, "little")), facts, F.lit(bytes(10)), _le(F.col("_at"), 4), name)
    whole = rows.select(*id, "ord", "_local", entry.alias("_entry")).groupBy(*id).agg(F.array_sort(F.collect_list(F.struct("ord", "_local", "_entry"))).alias("_m"))  # one archive
    joined = lambda field: F.unhex(F.array_join(F.transform("_m", lambda m: F.hex(m[field])), ""))
    laid = whole.select(*id, F.size("_m").alias("_n"), joined("_local").alias("_locals"), joined("_entry").alias("_directory"))
    end = F.concat(F.lit(_END + bytes(4)), _le(F.col("_n"), 2), _le(F.col("_n"), 2), _le(F.length("_directory"), 4), _le(F.length("_locals"), 4), F.lit(b"\0\0"))
    return laid.select(*id, F.concat("_locals", "_directory", end).alias("content"))
