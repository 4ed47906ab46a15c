"""Markup as a table of tokens: depths by running sums, elements as nested intervals, subtrees dropped by them.

Tokens come from two native regular expressions over the text (what matches, and what stands between
the matches), one row each. A running sum over opening and closing tags gives the depth; an element is
the interval from its opening tag to the next closing tag at its level, so "inside" is a comparison of
places. A subtree is dropped by the running depth of its name alone, as elements of other names inside
it do not matter; closing tags that nothing opened do not count.

Defined results: null markup has no tokens and stays null; names are compared without prefix and letter
case; an element that is never closed takes the rest with it; a tag or comment that nothing closes is
text. Windows run over one text at a time. ``id`` tells texts apart; rows that share one are refused by
giving each text its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comments, CDATA, processing instructions, declarations, closing tags, opening tags; quotes may hold ``>``.
TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?[^>]*+>|<!(?!--)[^>]*+>|</(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|<(?![!?/])(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""

#: Elements of HTML that have no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def _name(raw: Column) -> Column:
    whole = F.regexp_extract(raw, r"^</?\s*([^\s/>]*)", 1)
    return F.lower(F.regexp_extract(whole, r"([^:]*)$", 1))


def tokens(df: DataFrame, column: str, id: list[str], void: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ord, kind (open, close, empty, other, end), name, gap, raw, start: ``gap`` is the text before the token, ``start`` its place.

    The last row of a text has kind ``end`` and holds the text after its last token.
    """
    text = F.col(column)
    pieces = F.arrays_zip(F.split(text, TOKEN, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TOKEN), 0).alias("raw"))
    rows = df.filter(text.isNotNull()).select(*id, F.posexplode(pieces).alias("ord", "t")).select(*id, "ord", F.col("t.gap").alias("gap"), F.col("t.raw").alias("raw"))
    tag = F.col("raw").rlike(r"^<[^!?]")
    rows = rows.withColumn("name", F.when(tag, _name(F.col("raw"))))
    kind = F.when(F.col("raw").isNull(), "end").when(~tag, "other").when(F.startswith("raw", F.lit("</")), "close").when(F.endswith("raw", F.lit("/>")) | F.col("name").isin(*void), "empty").otherwise("open")
    rows = rows.withColumn("kind", kind)
    upto = Window.partitionBy(*id).orderBy("ord")
    width = F.length("gap") + F.coalesce(F.length("raw"), F.lit(0))
    start = F.sum(width).over(upto) - F.coalesce(F.length("raw"), F.lit(0))
    return rows.select(*id, "ord", "kind", "name", "gap", "raw", start.cast("bigint").alias("start"))


def _step() -> Column:
    return F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)


def depths(tokens: DataFrame, id: list[str]) -> DataFrame:
    """``tokens`` with ``level``: the depth of each tag's element from 1, for others that of the element around; stray ends do not count."""
    upto = Window.partitionBy(*id).orderBy("ord")
    sums = tokens.withColumn("_sum", F.sum(_step()).over(upto))
    depth = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto))
    stray = (F.col("kind") == "close") & (F.col("_sum") <= F.coalesce(F.min("_sum").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) & (F.col("_sum") < 0)
    level = F.when(stray, F.lit(None)).when(F.col("kind").isin("close", "empty"), depth + 1).otherwise(depth)
    return sums.withColumn("level", level.cast("int")).drop("_sum")


def elements(tokens: DataFrame, id: list[str]) -> DataFrame:
    """``id``, ord, name, level, parent, start, end: each element as the interval [start, end) of its text.

    ``parent`` is the ord of the element around. An element that is never closed has no end.
    """
    level = depths(tokens, id)
    ends = F.col("start") + F.length("raw")
    side = Window.partitionBy(*id, "level").orderBy("ord")
    tags = level.filter(F.col("kind").isin("open", "close", "empty") & F.col("level").isNotNull())
    nxt = F.lead(F.struct("kind", ends.alias("end"))).over(side)
    end = F.when(F.col("kind") == "empty", ends).when(nxt["kind"] == "close", nxt["end"])
    paired = tags.withColumn("end", end).filter("kind <> 'close'")
    # an element's parent is the last that opened one level up: both stand in the group of that level
    rows = paired.select(*id, "ord", "name", "level", "start", "end", "kind", F.explode(F.array("level", F.col("level") - 1)).alias("_group"))
    own = F.when((F.col("_group") == F.col("level")) & (F.col("kind") == "open"), F.col("ord"))
    parent = F.last(own, ignorenulls=True).over(Window.partitionBy(*id, "_group").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("parent", parent).filter("_group = level - 1").select(*id, "ord", "name", "level", "parent", "start", "end")


def without_elements(df: DataFrame, column: str, id: list[str], names: list[str], void: tuple[str, ...] = ()) -> DataFrame:
    """``id``, removed, cleaned: each text without the elements of the given local names, and how many outermost ones went."""
    rows = tokens(df, column, id, void)
    upto = Window.partitionBy(*id).orderBy("ord")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    inside, opens = F.lit(False), F.lit(False)
    for i, name in enumerate(sorted({n.lower() for n in names})):
        mine = F.when(F.col("name") == name, _step()).otherwise(0)
        rows = rows.withColumn(f"_sum{i}", F.sum(mine).over(upto))
        rows = rows.withColumn(f"_depth{i}", F.col(f"_sum{i}") - F.least(F.lit(0), F.min(f"_sum{i}").over(upto)))
        rows = rows.withColumn(f"_before{i}", F.coalesce(F.last(f"_depth{i}").over(before), F.lit(0)))
        inside |= F.col(f"_before{i}") > 0
        opens |= (F.col("name") == name) & F.col("kind").isin("open", "empty")
    piece = F.when(inside, "").otherwise(F.concat(F.col("gap"), F.when(opens, "").otherwise(F.coalesce("raw", F.lit("")))))
    kept = rows.select(*id, "ord", piece.alias("piece"), (opens & ~inside).cast("long").alias("gone"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "")  # one text
    out = kept.groupBy(*id).agg(F.sum("gone").alias("removed"), whole.alias("cleaned"))
    nulls = df.filter(F.col(column).isNull()).select(*id, F.lit(0).cast("long").alias("removed"), F.lit(None).cast("string").alias("cleaned"))
    return out.unionByName(nulls)
