"""Mixing sources to target weights by nested hash thresholds.

Each document has a fixed hash in 60 bits. Tokens are summed by source and hash bucket; the bucket in
which a source's running sum passes its budget is found, only that boundary bucket is cut into finer
buckets, and so on until one document (or rows with one hash) is left. The mix is then a filter
``hash < threshold``: nothing is sorted, reruns agree, and a larger budget takes a superset.

A target above the source's size takes every document once (twice at 2) and the thresholded share
once more, so no document gives more than ``CAP`` times its size.

Defined results: null text has size 0; a null source is a source of its own, after all others in
code-point order; rows with a null id hash like the text ``null``; repeated rows have one hash and
enter or stay out together; sources without words have target 0. An empty table gives an empty
table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, whole_row

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all sizes, as a fraction
CAP = 2
BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat along the sources in code-point order, null last. A target above ``cap`` times its
    source's size stops there; its excess is shared again by weight among the others. The water level
    at which all is shared is found from running sums over the sources, one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("most", (F.col("source_size") * cap).cast("double"))
    # sources fill up in the order of most / weight; all before the first that does not are at their most
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole) * float(share[0]) / float(share[1]))
    s = s.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    s = s.withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(whole)["level"]
    s = s.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the hash below which each source's items sum nearest to its budget.

    ``items`` is (source, size, hash), ``budgets`` (source, budget). Each level sums ``2**STEP`` buckets
    of the one bucket that holds the boundary.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("taken"))
    shift = BITS
    while shift > 0:
        shift -= STEP
        inside = items.alias("i").join(state.alias("s"), _same(F.col("i.source"), F.col("s.source")) & (F.shiftright("i.hash", shift + STEP) == F.shiftright("s.low", shift + STEP)))
        hist = inside.groupBy(F.col("i.source").alias("source"), F.shiftleft(F.shiftright("i.hash", shift), shift).alias("at")).agg(
            F.sum("i.size").alias("size"), F.first("s.budget").alias("budget"), F.first("s.taken").alias("taken")
        )
        order = Window.partitionBy("source").orderBy("at")
        hist = hist.withColumn("upto", F.col("taken") + F.sum("size").over(order))
        edge = hist.filter("upto > budget").groupBy("source").agg(F.min_by(F.struct("at", (F.col("upto") - F.col("size")).alias("taken"), "upto", "budget"), "at").alias("e"))
        nxt = edge.select("source", "e.budget", F.col("e.at").alias("low"), F.col("e.taken").alias("taken"), F.col("e.upto").alias("upto"))
        state = saved(nxt, "mix-edge")
    # one hash value is left: take it if that comes nearer
    near = F.col("upto") - F.col("budget") < F.col("budget") - F.col("taken")
    return state.select("source", F.when(near, F.col("low") + 1).otherwise(F.col("low")).alias("threshold"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of every document, written once."""
    return saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("hash")), "mix-items")


def plan(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rounds, threshold): a document is taken ``rounds`` times, and once more below the threshold."""
    totals = saved(targets(items.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    totals = totals.withColumn("rounds", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long"))
    budgets = totals.select("source", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"))
    edge = thresholds(items.select("source", "size", "hash"), budgets.filter("budget > 0"))
    both = totals.alias("t").join(edge.alias("e"), _same(F.col("t.source"), F.col("e.source")), "left")
    return saved(both.select("t.*", F.coalesce("e.threshold", F.lit(0)).alias("threshold")), "mix-plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document."""
    items = sized(docs)
    out = items.alias("i").join(plan(items, weights, share, cap).alias("p"), _same(F.col("i.source"), F.col("p.source")))
    taken = F.col("i.size") * (F.col("p.rounds") + (F.col("i.hash") < F.col("p.threshold")).cast("long"))
    return out.select("i.doc_id", "i.source", "i.size", "p.source_size", "p.target", taken.alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each document repeated as often as the mix takes it: none, once or ``CAP`` times.

    A document's turn count follows from its source's plan and its own hash, so texts are not shuffled
    by id; documents without words are left out. Columns travel inside one struct, so their names do not matter.
    """
    p = plan(sized(docs)).select("source", "rounds", "threshold")
    rows = docs.filter(docs["text"].rlike(WORD)).select(docs["source"].alias("source"), doc_hash(docs["doc_id"]).alias("hash"), whole_row(docs).alias("row"))
    out = rows.alias("d").join(p.alias("p"), _same(F.col("d.source"), F.col("p.source")))
    times = F.col("p.rounds") + (F.col("d.hash") < F.col("p.threshold")).cast("long")
    out = out.select("d.row", times.alias("times")).filter("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("turn")).select("row.*")


ORACLE = r"""
WITH items AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM items GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
  FROM sizes),
levels AS (
  SELECT *, most / weight AS fills, (total - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min_by(level, fills) AS level FROM levels WHERE level * weight < most),
goals AS (SELECT w.source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM weighed w, level),
run AS (
  SELECT i.*, source_size, target, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS rounds,
         CAST(sum(i.size) OVER (PARTITION BY i.source ORDER BY i.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
         CAST(sum(i.size) OVER (PARTITION BY i.source, i.hash) AS BIGINT) AS own
  FROM items i JOIN goals g ON i.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, target - rounds * source_size AS budget FROM run)
SELECT doc_id, size, source_size, target,
       CAST(size * (rounds + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       source
FROM cut
"""
