"""First matching rule by prefix, as an equality join instead of a comparison of all with all.

Rules are a table (ord, prefix, ...). A text can only match prefixes of the lengths that occur, so it meets
the rules by one key per length; of the matches the one with the smallest ord stays. Up to ``BROADCAST`` rules
of up to ``LENGTHS`` lengths are broadcast once and joined length by length: a text stays one row where it
is, nothing is shuffled, sorted or grouped. Beyond, each text offers its keys as rows, which are joined by
shuffle and reduced by a partial aggregate; a rule that a third of all texts match is then spread by
Spark's skew handling, as each text's keys stand alone.

Prefixes are compared without letter case in A-Z where asked. An empty prefix matches every text, a null
text or prefix nothing. Of rules with one ord and prefix any may stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST, LENGTHS = 100_000, 32
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def first_by_prefix(rows: DataFrame, id: list[str], column: str, rules: DataFrame, value: str, any_case: bool = True) -> DataFrame:
    """``id``, ``value`` of the first rule whose prefix the text starts with, null where none does; ``id`` tells rows apart."""
    fold = (lambda c: F.translate(c, _A, _Z)) if any_case else (lambda c: c)
    known = rules.filter("prefix is not null").select("ord", fold(F.col("prefix")).alias("_key"), F.col(value).alias("_value"))
    known = known.groupBy("_key").agg(F.min(F.struct("ord", "_value")).alias("_rule")).withColumn("_n", F.length("_key"))
    sizes = {r[0]: r[1] for r in known.groupBy("_n").count().collect()}  # lengths of prefixes
    few = sum(sizes.values()) <= BROADCAST
    text = fold(F.col(column))
    if few and len(sizes) <= LENGTHS:
        out, best = rows.select(*id, text.alias("_text")), []
        for n in sorted(sizes):
            key = F.when(F.length("_text") >= n, F.substring("_text", 1, n))
            best.append(F.col(f"_r{n}._rule"))
            out = out.join(F.broadcast(known.select("_key", "_rule")).alias(f"_r{n}"), key == F.col(f"_r{n}._key"), "left")
        none = F.lit(None).cast(known.schema["_rule"].dataType)
        return out.select(*id, F.least(none, none, *best)["_value"].alias(value))
    ns = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>"), lambda n: n <= F.length(text))
    keys = rows.filter(F.col(column).isNotNull()).select(*id, F.explode(F.transform(ns, lambda n: F.struct(n.alias("_n"), F.substring(text, F.lit(1), n).alias("_key")))).alias("_k"))
    met = keys.select(*id, "_k._n", "_k._key").join(known.hint("broadcast" if few else "merge"), ["_n", "_key"])
    best = met.groupBy(*id).agg(F.min("_rule")["_value"].alias(value))
    return rows.select(*id).join(best, id, "left")
