"""A handbook of what files give away, as searchable rows: eight sections, each a table of its own shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import matches_search

#: Section, its columns (the first is the title) and its rows.
SECTIONS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, ...], ...]]] = {
    "files": (
        ("format", "treatment"),
        (
            ("JPEG", "rebuilt from its picture segments"), ("PNG", "rebuilt from its picture chunks"), ("WebP", "rebuilt, frames included"), ("GIF", "rebuilt, with one loop extension"),
            ("TIFF", "directories written anew, pixels copied"), ("HEIF", "items overwritten in place"), ("AVIF", "items overwritten in place"), ("SVG", "edited as text"),
            ("XMP sidecar", "replaced by an empty packet"), ("PDF", "written anew from its objects"), ("OOXML", "parts replaced or edited, images cleaned"),
            ("OpenDocument", "parts replaced or edited, images cleaned"), ("video", "recognised, not cleaned"), ("audio", "recognised, not cleaned"), ("ZIP", "recognised, not cleaned"),
            ("unknown format", "left as it is"),
        ),
    ),
    "metadata": (
        ("kind", "content", "use"),
        (
            ("EXIF", "camera, lens, exposure and time", "often the place of a picture"), ("XMP", "editing software, history, keywords", "rights and people in RDF"),
            ("IPTC", "captions, bylines and contacts", "by newsroom software"), ("maker note", "serial numbers and counters", "in a vendor's own format"),
            ("thumbnail", "an earlier version of the picture", "uncropped at times"), ("colour profile", "the device of a calibration", "and its day"),
            ("comment", "free text", "by software or people"), ("trailing data", "anything after the file's own end", "whole videos at times"),
            ("unrecognised structure", "what is not on the keep-list", "unknown until read"), ("document info", "title, software and dates", "of a document"),
            ("author identity", "names of authors and editors", "and of reviewers"), ("timestamp", "when something was made", "or changed"),
            ("revision identifiers", "ids of one editing session", "tie files together"), ("archive entry metadata", "times and system fields", "of archive entries"),
            ("custom property", "fields of one application", "or organisation"),
        ),
    ),
    "raw": (("heading", "body"), (("In place", "values are zeroed where they lie, because offsets inside maker notes cannot be mended"), ("Previews", "pictures inside a raw are blanked like any JPEG"))),
    "fingerprint": (("heading", "body"), (("Sensor pattern", "each sensor adds a faint pattern of its own to all of its pictures"), ("Washing", "denoising, scaling and noise weaken the pattern, at a loss of detail"))),
    "beyond_file": (("heading", "body"), (("Names", "file names hold dates and counters"), ("Content", "signs, faces and voices stay what they are"), ("Carriers", "servers and networks keep records of their own"))),
    "myths": (("claim", "reality"), (("Screenshots hold nothing", "they hold software, time and screen size"), ("Renaming is enough", "fields inside do not change with the name"))),
    "evidence": (("heading", "body"), (("Keep the original", "whoever must prove where a file came from needs it untouched"), ("Write down sums", "a digest shows later that nothing changed"))),
    "letter": (("heading", "body"), (("Assurance", "complete: nothing outside the keep-list is left; best effort: known data is gone, other structures may remain; none: nothing was removed"),)),
}


def section(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = SECTIONS[name]
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns))


def handbook(spark: SparkSession) -> DataFrame:
    """(category, title, body) over all sections; columns after the title form the body."""
    entries = [(name, row[0], "; ".join(row[1:])) for name, (_, rows) in SECTIONS.items() for row in rows]
    return spark.createDataFrame(entries, "category string, title string, body string")


def search(entries: DataFrame, query: str | Column = "", category: str | None = None) -> DataFrame:
    """Entries that hold the text, letter case aside, in a category or in any."""
    out = entries.filter(matches_search(query, F.col("title"), F.col("body")))
    return out if category is None else out.filter(F.col("category") == category)


def nothing_found(entries: DataFrame, query: str | Column) -> DataFrame:
    """One row: whether no section holds the text."""
    return search(entries, query).agg((F.count("*") == 0).alias("nothing_found"))
