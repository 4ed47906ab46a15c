"""Questions over reports: plain aggregations, joins and derived columns on the scrub result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import ASSURANCE, NONE, dim_format, dim_kind

# --- derived columns -----------------------------------------------------------------------------


def is_clean() -> Column:
    return F.size("removed") == 0


def bytes_removed() -> Column:
    return F.aggregate("removed", F.lit(0).cast("long"), lambda t, r: t + r["bytes"])


def assurance_label(dash: str = " ") -> Column:
    out = F
    for i, name in enumerate(ASSURANCE):
        out = out.when(F.col("assurance") == i, name.replace(" ", dash))
    return out


def summary() -> Column:
    """One line on a file: its format and outcome as ``key=value`` words."""
    words = F.concat_ws(
        " ", F.concat(F.lit("findings="), F.size("removed").cast("string")), F.concat(F.lit("bytes="), bytes_removed().cast("string")),
        F.when(F.col("found_location"), F.lit("place=yes")), F.concat(F.lit("assurance="), assurance_label("-")),
    )
    outcome = F.when(F.col("assurance").isNull(), F.concat(F.lit("failed ("), F.col("error.detail"), F.lit(")"))).when(F.col("assurance") == NONE, F.lit("left as it was")).otherwise(words)
    return F.concat(F.coalesce("format", F.lit("?")), F.lit(" | "), outcome)


def exit_code() -> Column:
    """0 done, 1 error, 2 not a format that can be cleaned."""
    return F.when(F.col("assurance").isNull(), 1).when(F.col("assurance") == NONE, 2).otherwise(0)


def human_size(n: Column) -> Column:
    kb = n / 1024.0
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(kb < 1024, F.concat(F.format_string("%.1f", F.bround(kb, 1)), F.lit(" kB")))
        .when(kb < 1024**2, F.concat(F.format_string("%.1f", F.bround(kb / 1024, 1)), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(kb / 1024**2, 1)), F.lit(" GB")))
    )


# --- shapes --------------------------------------------------------------------------------------


def findings(reports: DataFrame, *keep: str) -> DataFrame:
    """One row per removed item, in order."""
    return reports.select(*keep, "format", F.explode("removed").alias("r")).select(*keep, "format", "r.ord", "r.kind", "r.location", "r.bytes")


def retained(reports: DataFrame, *keep: str) -> DataFrame:
    return reports.select(*keep, "format", F.explode("retained").alias("r")).select(*keep, "format", "r.what", "r.reveals")


def loud(reports: DataFrame) -> DataFrame:
    """Without the rows that have nothing to say."""
    return reports.filter(~(is_clean() & (F.size("warnings") == 0)) | F.col("assurance").isNull())


def writable(reports: DataFrame) -> DataFrame:
    """Rows that have an output worth writing."""
    return reports.filter(F.col("assurance") < NONE)


def as_json(file: Column, bridge: bool = False) -> Column:
    """A report as a JSON object; ``bridge`` leaves out the file and the verification and joins label words."""
    items = F.transform("removed", lambda r: F.struct(r["kind"].alias("kind"), r["location"].alias("location"), r["bytes"].alias("bytes")))
    body = [
        F.col("format").alias("format"), assurance_label("_" if bridge else " ").alias("assurance"), F.col("found_location").alias("found_location"),
        F.col("input_len").alias("input_bytes"), F.col("output_len").alias("output_bytes"), items.alias("removed"), F.col("retained").alias("retained"),
    ]
    warnings = [F.col("warnings").alias("warnings")]
    if bridge:
        return F.to_json(F.struct(*body, *warnings))
    return F.to_json(F.struct(file.alias("file"), *body, F.col("verification").alias("verification"), *warnings))


def as_text() -> Column:
    """A report as lines: the summary, then one ``section<TAB>what<TAB>detail`` line for each thing it lists."""

    def lines(section: str, items: str, what, detail) -> Column:
        return F.transform(items, lambda x: F.concat_ws("\t", F.lit(section), what(x), detail(x)))

    removed = lines("gone", "removed", lambda r: r["kind"], lambda r: F.concat(r["location"], F.lit(" ("), r["bytes"].cast("string"), F.lit(")")))
    kept = lines("kept", "retained", lambda r: r["what"], lambda r: r["reveals"])
    notes = lines("note", "warnings", lambda w: w, lambda w: F.lit(None).cast("string"))
    v = F.col("verification")
    checks = F.array(
        F.concat_ws("\t", F.lit("check"), F.lit("second pass finds nothing"), v["output_reinspected_clean"].cast("string")),
        F.concat_ws("\t", F.lit("check"), F.lit("second pass gives the same bytes"), v["deterministic"].cast("string")),
    )
    checked = F.when(v.isNotNull(), checks).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(summary()), removed, kept, notes, checked), "\n")


# --- aggregates ----------------------------------------------------------------------------------


def by_kind(reports: DataFrame) -> DataFrame:
    """(kind_ord, kind, n, bytes) of all findings."""
    spark = reports.sparkSession
    f = findings(reports).groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return dim_kind(spark).join(f, "kind").select("kind_ord", "kind", "n", "bytes")


def by_format_and_kind(reports: DataFrame) -> DataFrame:
    """Totals by format and kind, by format, and over all."""
    return findings(reports).rollup("format", "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def assurance_buckets(reports: DataFrame) -> DataFrame:
    """Files cleaned completely, in part, and skipped or failed, by format."""
    a = F.col("assurance")
    return reports.groupBy("format").agg(
        F.count_if(a == 0).alias("complete"), F.count_if(a == 1).alias("partial"), F.count_if(a.isNull() | (a == NONE)).alias("skipped"), F.bool_or("found_location").alias("any_location")
    )


def worst(reports: DataFrame) -> DataFrame:
    """The weakest assurance, whether any place was found, and the exit code of a run."""
    return reports.agg(F.max("assurance").cast("int").alias("assurance"), F.bool_or("found_location").alias("found_location"), F.max(exit_code()).alias("exit_code"))


def absorbed(parents: DataFrame, children: DataFrame, key: str = "parent_id") -> DataFrame:
    """(key, assurance, found_location, n_removed, bytes) of parents with the reports of their parts taken in."""
    both = parents.select(key, "assurance", "found_location", "removed").unionByName(children.select(key, "assurance", "found_location", "removed"))
    return both.groupBy(key).agg(
        F.max("assurance").alias("assurance"), F.bool_or("found_location").alias("found_location"), F.sum(F.size("removed")).alias("n_removed"), F.sum(bytes_removed()).alias("bytes")
    )


def coverage(reports: DataFrame) -> DataFrame:
    """Every known format with its number of files, 0 included."""
    n = reports.groupBy("format").agg(F.count("*").alias("files"))
    return dim_format(reports.sparkSession).join(n, "format", "left").select("format_ord", "format", F.coalesce("files", F.lit(0)).alias("files"))
