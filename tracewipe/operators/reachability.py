"""Which objects of a file its roots reach, over tables of objects and references.

A frontier moves along the references, one join and one anti join with what was visited per step. As
such a loop takes a step for each link of the longest path, chains are taken out first: a node with one
incoming reference is reached with its only referrer, so it points there, and pointers are doubled until
they end at a root or a node with several referrers, in as many rounds as the chain's length has bits.
The frontier then moves over those heads alone. A ring that nothing outside refers to never ends; its
pointers stop after the same rounds and stay unreached.

Graphs of all files are settled together, so a file with a third of all objects is spread over the
cluster like the rest; a node that many refer to is one row per referrer and joined by key, with the
repeats of a reference taken out before.

Keys are ``file`` and a node number; both sides of a reference lie in one file. References to nodes that
do not exist, null ends, repeats and self references are allowed and reach nothing new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Rounds

KEY = ["file", "node"]
FEW = 1_000_000  # rows of a frontier that are broadcast


def _count(df: DataFrame) -> int:
    return df.count()


def reachable(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(file, node) of the roots and all that they reach; ``roots`` is (file, node), ``links`` (file, node, to)."""
    spark = roots.sparkSession
    rounds = Rounds(spark, "reach")
    start = rounds.saved(roots.select(*KEY).dropna().distinct())
    edges = rounds.saved(links.select(*KEY, "to").dropna().filter("node <> to").distinct())

    # nodes with one referrer that are no roots point to it
    single = edges.groupBy("file", "to").agg(F.count("*").alias("n"), F.min("node").alias("up")).filter("n = 1").select("file", F.col("to").alias("node"), "up")
    point = rounds.saved(single.join(start, KEY, "left_anti"))
    left, most = _count(point), 0
    nodes = left
    while left and 2**most < 2 * nodes:
        most += 1
        higher = point.select("file", F.col("node").alias("up"), F.col("up").alias("higher"))
        doubled = point.join(higher, ["file", "up"], "left").select("file", "node", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved"))
        before, point = point, rounds.saved(doubled)
        rounds.drop(before)
        left = _count(point.filter("moved"))
        point = point.select("file", "node", "up")
    heads = rounds.saved(point)

    # references between heads: from the referrer's head to a node that is a head itself
    into = edges.join(heads.select("file", F.col("node").alias("to")), ["file", "to"], "left_anti")
    lifted = into.join(heads.select("file", "node", F.col("up").alias("head")), KEY, "left").select("file", F.coalesce("head", "node").alias("node"), "to")
    above = rounds.saved(lifted.filter("node <> to").distinct())
    seen = frontier = start
    size = _count(start)
    while size:
        # a small frontier is broadcast: neither the references nor what was visited is shuffled for it
        few = size <= FEW
        reached = rounds.saved((F.broadcast(frontier) if few else frontier).join(above, KEY).select("file", F.col("to").alias("node")).distinct())
        if _count(reached) <= FEW:
            again = seen.join(F.broadcast(reached), KEY, "left_semi").distinct()
            frontier = rounds.saved(reached.join(F.broadcast(again), KEY, "left_anti"))
        else:
            frontier = rounds.saved(reached.join(seen, KEY, "left_anti"))
        rounds.drop(reached)
        size = _count(frontier)
        if size:
            seen = seen.unionByName(frontier)
    along = heads.join(seen.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi").select(*KEY)
    return seen.unionByName(along)


def orphans(objects: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``objects`` (file, node, ...) that no root reaches."""
    return objects.join(reachable(roots, links), KEY, "left_anti")


# --- PDF -----------------------------------------------------------------------------------------

# Possessive forms of (?:^|[\s>])(\d{1,10})\s+(\d{1,5})\s+obj\b(.*?)\bendobj and (\d{1,10})\s+\d{1,5}\s+R\b: what they match is the
# same, but no digit or letter of a long body is tried again.
_OBJECT = r"(?:^|[\s>])\d{1,10}+\s++\d{1,5}+\s++obj\b(?:[^e]++|(?!\bendobj)e)*+endobj"
_HEAD = r"^[\s>]?(\d{1,10})\s+\d{1,5}\s+obj"
_REFERENCE, _ENDS_REFERENCE = r"(\d{1,10}+)\s++\d{1,5}+\s++R\b", r"\sR\b"
_ROOT = r"/Root\s+(\d{1,10})\s+\d{1,5}\s+R"


def _found(files: DataFrame, file: str) -> DataFrame:
    """(file, roots, at, node, body, to): a row for each object in the order of its file, found in one pass without a shuffle.

    ``roots`` stands in a file's first row only; a file without objects has that row alone, with ``node`` null. ``to`` are the
    body's references.
    """
    text = F.decode("content", "ISO-8859-1")
    rows = files.select(F.col(file).alias("file"), text.alias("text")).select(
        "file", F.regexp_extract_all("text", F.lit(_ROOT), 1).cast("array<long>").alias("roots"), F.posexplode_outer(F.regexp_extract_all("text", F.lit(_OBJECT), 0)).alias("at", "o")
    )
    head = F.length(F.regexp_extract("o", _HEAD, 0))
    body = F.substring_index(F.substring(F.col("o"), head + 1, F.length("o") - head - len("endobj")), "stream", 1)
    first = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("roots")).alias("roots")
    cut = rows.select("file", first, "at", F.regexp_extract("o", _HEAD, 1).cast("long").alias("node"), body.alias("body"))
    to = F.when(F.col("body").rlike(_ENDS_REFERENCE), F.regexp_extract_all("body", F.lit(_REFERENCE), 1).cast("array<long>"))
    return cut.withColumn("to", F.coalesce(to, F.array().cast("array<long>")))


def _last(found: DataFrame, *columns: str) -> DataFrame:
    """(file, node, ...): of several objects with one number the last."""
    return found.filter("node IS NOT NULL").groupBy("file", "node").agg(*[F.max_by(c, "at").alias(c) for c in columns])


def pdf_objects(files: DataFrame, file: str = "path") -> DataFrame:
    """(file, node, body, to) for the objects of PDF files that keep them outside object streams; of several with one number the last.

    ``body`` is the object's text in Latin-1, up to its stream if it has one, ``to`` what it refers to. Bodies are shuffled only
    where they are asked for.
    """
    return _last(_found(files, file), "body", "to")


def pdf_references(objects: DataFrame) -> DataFrame:
    """(file, node, to) of the references in ``objects``."""
    return objects.select("file", "node", F.explode("to").alias("to"))


def pdf_roots(files: DataFrame, file: str = "path") -> DataFrame:
    """(file, node): the catalogs that trailers name under /Root."""
    found = F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(_ROOT), 1)
    return files.select(F.col(file).alias("file"), F.explode(found).alias("node")).select("file", F.col("node").cast("long"))


def pdf_graph(files: DataFrame, file: str = "path") -> tuple[DataFrame, DataFrame]:
    """Objects (file, node, to) without their bodies, and roots (file, node), as ``pdf_objects`` and ``pdf_roots`` find them.

    Files are read once, in one map; what is written of them and used from then on are numbers.
    """
    rounds = Rounds(files.sparkSession, "pdf")
    found = rounds.saved(_found(files, file).select("file", "roots", "at", "node", "to"))
    return rounds.saved(_last(found, "to")), found.select("file", F.explode("roots").alias("node"))
